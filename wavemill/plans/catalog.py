"""Queries over the test tables, with the DuckDB SQL that gives the same rows.

The tables hold no audio: events (by event_id) stand in for samples, frames and runs, pages' html for byte streams, and
lineitem (by order) for packet streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavemill.functions import bits, signal
from wavemill.operators import chunks, fold, index, meta, resample, runs
from wavemill.plans import options
from wavemill.sources import audio

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Order of an order's lines; (l_orderkey, l_linenumber) repeats.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
_LINE_ORDER = ", ".join(LINE_ORDER)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER, "l_returnflag", "l_discount", F.col("l_quantity").cast("int").alias("qty"))


_RATES = "[" + ", ".join(map(str, signal.LEGAL_RATES)) + "]"
_NEAREST = f"""CASE WHEN list_contains({_RATES}, r) THEN r WHEN r % 44100 = 0 THEN 44100 WHEN r % 48000 = 0 THEN 48000
    WHEN r % 22050 = 0 THEN 22050 WHEN r % 24000 = 0 THEN 24000
    ELSE list_min(list_transform({_RATES}, lambda x: abs(r - x) * 100000 + x)) % 100000 END"""


# Samples


@query("SELECT event_id, greatest(-32768, least(32767, floor(value * 150 - 30000 + 0.5)))::INTEGER AS s16 FROM events")
def q01_pcm16_quantise(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", signal.saturate16(F.col("value") * 150 - 30000).alias("s16"))


@query("""SELECT event_id, ((event_id % 256) - 128)::INTEGER * 256 AS from_u8, round(((event_id % 65536) - 32768) / 32768::DOUBLE, 9) AS n16,
    round(((event_id * 16777) % 16777216 - 8388608) * 256::DOUBLE / 2147483648::DOUBLE, 9) AS n24,
    round(greatest(-1::DOUBLE, least(1::DOUBLE, value / 256 - 1)), 9) AS clamped FROM events""")
def q23_normalise(spark, sf_dir):
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    return e.select("event_id", signal.from_u8((i % 256).cast("int")).alias("from_u8"), F.round(signal.normalise16(i % 65536 - 32768), 9).alias("n16"), F.round(signal.normalise24((i * 16777) % 16777216 - 8388608), 9).alias("n24"), F.round(signal.clamp(F.col("value") / 256 - 1), 9).alias("clamped"))


@query("SELECT event_id, event_id // 2 AS frame, (event_id % 2)::INTEGER AS ch, event_id AS back, value FROM events")
def q17_deinterleave(spark, sf_dir):
    rows = chunks.deinterleave(read(spark, sf_dir, "events").select("event_id", "value"), "event_id", 2)
    return chunks.interleave(rows, "back", 2).select("event_id", "frame", "ch", "back", "value")


@query(f"""WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 22050 * (1 + event_id % 17) WHEN 1 THEN 24000 * (1 + event_id % 13)
    WHEN 2 THEN 44100 * (1 + event_id % 8) ELSE 7000 + event_id * 97 % 120000 END AS r FROM events)
    SELECT event_id, r AS rate, ({_NEAREST})::INTEGER AS nearest FROM x""")
def q11_nearest_rate(spark, sf_dir):
    i = F.col("event_id")
    rate = F.when(i % 4 == 0, 22050 * (1 + i % 17)).when(i % 4 == 1, 24000 * (1 + i % 13)).when(i % 4 == 2, 44100 * (1 + i % 8)).otherwise(7000 + i * 97 % 120000)
    rows = read(spark, sf_dir, "events").select("event_id", rate.alias("rate"))
    return rows.select("event_id", "rate", signal.nearest_rate(F.col("rate")).cast("int").alias("nearest"))


@query(f"""WITH x AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 11000 + event_id % 40000 END AS asked, CASE WHEN event_id % 3 = 0 THEN 32000 END AS encoder,
    44100 + event_id % 7 * 1000 AS source FROM events), y AS (SELECT *, coalesce(asked, source) AS r FROM x)
    SELECT event_id, CASE WHEN asked IS NULL AND encoder IS NOT NULL THEN encoder ELSE {_NEAREST} END::INTEGER AS rate,
    (event_id * (CASE WHEN asked IS NULL AND encoder IS NOT NULL THEN encoder ELSE {_NEAREST} END) // source)::BIGINT AS frames FROM y""")
def q28_output_rate(spark, sf_dir):
    i = F.col("event_id")
    source = 44100 + i % 7 * 1000
    rate = signal.output_rate(F.when(i % 5 == 0, 11000 + i % 40000), F.when(i % 3 == 0, F.lit(32000)), source).cast("int")
    return read(spark, sf_dir, "events").select("event_id", rate.alias("rate"), signal.resampled_length(i, source, rate).alias("frames"))


@query("""SELECT user_id, count(*) AS n, round(CASE WHEN sum(d * d) = 0 THEN -999 ELSE 20 * log10(sqrt(avg(d * d))) END, 6) AS db
    FROM (SELECT user_id, (value - floor(value)) / 512 AS d FROM events) GROUP BY user_id""")
def q13_rms_diff_db(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    a = e.select("user_id", "event_id", (F.col("value") / 512).alias("a"))
    b = e.select("event_id", (F.floor("value") / 512).alias("b"))
    d = F.col("a") - F.col("b")
    return a.join(b, "event_id").groupBy("user_id").agg(F.count("*").alias("n"), F.round(signal.rms_db(d * d), 6).alias("db"))


@query("""SELECT max(db) AS worst, count(*) AS n FROM (SELECT round(CASE WHEN sum(d * d) = 0 THEN -999 ELSE 20 * log10(sqrt(avg(d * d))) END, 6) AS db
    FROM (SELECT user_id, (value - floor(value)) / 512 AS d FROM events) GROUP BY user_id)""")
def q36_worst_case(spark, sf_dir):
    return q13_rms_diff_db(spark, sf_dir).agg(F.max("db").alias("worst"), F.count("*").alias("n"))


_LINEAR = """WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value AS x FROM events),
    n AS (SELECT user_id, count(*) AS n FROM s GROUP BY user_id),
    j AS (SELECT user_id, n, unnest(range(n * 147 // 160)) AS j FROM n)
    SELECT j.user_id, j.j AS idx, round(a.x + (coalesce(b.x, a.x) - a.x) * ((j.j * 160 % 147) / 147::DOUBLE), 6) AS value
    FROM j JOIN s a ON a.user_id = j.user_id AND a.i = j.j * 160 // 147 LEFT JOIN s b ON b.user_id = j.user_id AND b.i = j.j * 160 // 147 + 1"""


def _streams(spark, sf_dir) -> DataFrame:
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long") - 1
    return read(spark, sf_dir, "events").select("user_id", idx.alias("idx"), "value")


@query(_LINEAR)
def q21_linear_resample(spark, sf_dir):
    return resample.linear(_streams(spark, sf_dir), "user_id", "idx", "value", 160, 147).withColumn("value", F.round("value", 6))


#: The kernel of 44100 to 48000 Hz, 160 phases of 66 taps: a sinc under a Kaiser window, whose Bessel function is its power series.
_SINC = """WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value / 512 AS x FROM events),
    t AS (SELECT p, n, n - p / 160e0 AS t FROM range(160) a(p), range(-32, 34) b(n)),
    w AS (SELECT p, n, CASE WHEN t = 0 THEN 1e0 ELSE sin(pi() * 0.97e0 * t) / (pi() * 0.97e0 * t) END * list_sum(list_transform(range(48), lambda k: power(9e0 * sqrt(greatest(0e0, 1 - (t / 33) * (t / 33))) / 2, 2 * k) / power(gamma(k + 1e0), 2))) AS w FROM t),
    b AS (SELECT p, n, w / sum(w) OVER (PARTITION BY p) AS w FROM w),
    j AS (SELECT user_id, unnest(range(count(*) * 48000 // 44100)) AS j FROM events GROUP BY user_id)
    SELECT j.user_id, j.j AS idx, round(greatest(-1e0, least(1e0, sum(s.x * b.w))), 9) AS value FROM j JOIN b ON b.p = j.j * 147 % 160
    JOIN s ON s.user_id = j.user_id AND s.i = j.j * 147 // 160 + b.n GROUP BY 1, 2"""


@query(_SINC)
def q45_windowed_sinc(spark, sf_dir):
    s = _streams(spark, sf_dir).withColumn("value", F.col("value") / 512)
    return resample.windowed_sinc(s, "user_id", "idx", "value", 44100, 48000).withColumn("value", F.round("value", 9))


# Chunks


_CHUNKED = """SELECT *, f - c * 124 AS pos FROM (SELECT event_id, value, event_id // 10 AS f, unnest(range(greatest(0, ceil((event_id // 10 - 127) / 124.0)::BIGINT), event_id // 10 // 124 + 1)) AS c FROM events)"""


def _chunked(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", "value", F.floor(F.col("event_id") / 10).cast("long").alias("frame"))
    return chunks.explode_chunks(rows, "frame")


@query(f"SELECT c AS chunk_id, count(*) AS n, min(f) AS first_frame, max(f) AS last_frame FROM ({_CHUNKED}) GROUP BY c")
def q03_overlap_chunks(spark, sf_dir):
    return _chunked(spark, sf_dir).groupBy("chunk_id").agg(F.count("*").alias("n"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


@query(f"""SELECT c AS ch, count(*) AS n, round(CASE WHEN sum(x * x) = 0 THEN -999 ELSE 20 * log10(sqrt(avg(x * x))) END, 6) AS db
    FROM (SELECT c, pos, value / 512 AS x FROM ({_CHUNKED})) WHERE c = 0 OR pos >= 4 GROUP BY c""")
def q04_chunk_rms_db(spark, sf_dir):
    x = F.col("value") / 512
    kept = chunks.discard_overlap(_chunked(spark, sf_dir))
    return kept.groupBy(F.col("chunk_id").alias("ch")).agg(F.count("*").alias("n"), F.round(signal.rms_db(x * x), 6).alias("db"))


@query(f"SELECT event_id, c AS chunk_id, pos::INTEGER AS pos, value FROM ({_CHUNKED}) WHERE c = 0 OR pos >= 4")
def q05_overlap_roundtrip(spark, sf_dir):
    return chunks.discard_overlap(_chunked(spark, sf_dir)).select("event_id", "chunk_id", "pos", "value")


@query(f"SELECT (c % 8)::INTEGER AS worker, count(DISTINCT c) AS n_chunks, count(*) AS n FROM ({_CHUNKED}) GROUP BY 1")
def q29_round_robin(spark, sf_dir):
    return chunks.dispatch(_chunked(spark, sf_dir), 8).groupBy("worker").agg(F.count_distinct("chunk_id").alias("n_chunks"), F.count("*").alias("n"))


@query("""WITH n AS (SELECT count(*) AS n FROM events), k AS (SELECT n, unnest(range(7)) AS k FROM n)
    SELECT k.k::INTEGER AS part, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id
    FROM events JOIN k ON event_id >= n * k // 7 AND event_id < n * (k + 1) // 7 GROUP BY 1""")
def q20_range_split(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id")
    total = e.agg(F.count("*").alias("total"))
    rows = e.crossJoin(F.broadcast(total)).withColumn("part", chunks.range_of(F.col("event_id"), F.col("total"), 7))
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


# Levels


@query(f"""WITH s AS (SELECT *, sum((26 - l_quantity::INTEGER) * 20) OVER w AS s FROM lineitem
    WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER} ROWS UNBOUNDED PRECEDING))
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    (s - greatest(0, max(s - 511) OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER} ROWS UNBOUNDED PRECEDING)))::BIGINT AS level FROM s""")
def q06_reservoir_window(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("change", (26 - F.col("qty")) * 20)
    return fold.capped_level(rows, ["l_orderkey"], LINE_ORDER, "change", fold.CAP_1).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "level")


@query(f"""WITH x AS (SELECT l_orderkey, list((26 - l_quantity::INTEGER) * 20 ORDER BY {_LINE_ORDER}) AS d, count(*) AS n FROM lineitem GROUP BY 1),
    y AS (SELECT l_orderkey, n, list_reduce(list_prepend(0, d), lambda a, q: least(511, greatest(0, a + q)))::BIGINT AS level FROM x)
    SELECT l_orderkey, n, level, greatest(0, level - 255)::BIGINT AS excess FROM y""")
def q07_reservoir_fold(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("change", (26 - F.col("qty")) * 20)
    out = fold.fold_level(rows, ["l_orderkey"], LINE_ORDER, "change", fold.CAP_1)
    return out.select("l_orderkey", "n", "level", fold.excess(F.col("level"), fold.CAP_2).cast("long").alias("excess"))


# Bits and bytes


_WORD = "(4292870144 + (event_id * 1540483477 + 12345) % 2097152)"
_BR1, _BR2 = (f"[{', '.join(map(str, t))}]" for t in (bits.BITRATES_1, bits.BITRATES_2))
_SR = "[" + ", ".join(str(r) for m in range(4) for r in bits.RATES[m]) + "]"
_FIELDS = f"""SELECT *, CASE WHEN sr > 0 THEN (CASE WHEN mode = 3 THEN 144 ELSE 72 END) * br // sr + padding END AS frame_size FROM (
    SELECT *, CASE WHEN mode = 3 THEN {_BR1}[br_idx + 1] ELSE {_BR2}[br_idx + 1] END AS br, {_SR}[mode * 4 + sr_idx + 1] AS sr,
    CASE WHEN w // 65536 & 1 = 1 THEN 4 ELSE 6 END AS header_len, w // 64 & 3 = 3 AS mono FROM (
    SELECT event_id, w, w // 524288 & 3 AS mode, w // 131072 & 3 AS layer, w // 4096 & 15 AS br_idx, w // 1024 & 3 AS sr_idx, w // 512 & 1 AS padding
    FROM (SELECT event_id, {_WORD} AS w FROM events)))"""
_VALID = "coalesce(mode <> 1 AND layer = 1 AND br_idx NOT IN (0, 15) AND sr_idx <> 3 AND frame_size >= 24, false)"


def words(spark, sf_dir) -> DataFrame:
    """Header words of all kinds, from the events' ids."""
    return read(spark, sf_dir, "events").select("event_id", (F.lit(4292870144) + (F.col("event_id") * 1540483477 + 12345) % 2097152).alias("w"))


@query(f"""SELECT event_id, mode::INTEGER AS mode, layer::INTEGER AS layer, br_idx::INTEGER AS br_idx, sr_idx::INTEGER AS sr_idx, padding::INTEGER AS padding,
    header_len::INTEGER AS header_len, (CASE WHEN mode = 3 THEN (CASE WHEN mono THEN 17 ELSE 32 END) ELSE (CASE WHEN mono THEN 9 ELSE 17 END) END)::INTEGER AS side_len,
    frame_size::INTEGER AS frame_size, {_VALID} AS valid FROM ({_FIELDS})""")
def q10_header_decode(spark, sf_dir):
    w = F.col("w")
    return words(spark, sf_dir).select("event_id", bits.mode(w).alias("mode"), bits.layer(w).alias("layer"), bits.bitrate_index(w).alias("br_idx"), bits.rate_index(w).alias("sr_idx"), bits.padding(w).alias("padding"), bits.header_length(w).alias("header_len"), bits.side_info_length(w).alias("side_len"), bits.frame_size(w).alias("frame_size"), bits.valid(w).alias("valid"))


@query(f"""SELECT event_id, (w - (w // 4096 & 15) * 4096 + (event_id % 16) * 4096)::BIGINT AS rated, (w - (w // 512 & 1) * 512 + (event_id % 2) * 512)::BIGINT AS padded,
    (CASE WHEN w // 524288 & 3 = 3 THEN event_id % 512 * 128 + w % 128 ELSE event_id % 256 * 256 + w % 256 END)::BIGINT AS pointed
    FROM (SELECT event_id, {_WORD} AS w FROM events)""")
def q24_header_setters(spark, sf_dir):
    w, i = F.col("w"), F.col("event_id")
    return words(spark, sf_dir).select("event_id", bits.with_bitrate_index(w, i % 16).alias("rated"), bits.with_padding(w, i % 2).alias("padded"), bits.with_main_data_offset(w % 65536, bits.mode(w) == 3, i).alias("pointed"))


def _sql_twelve(at: int) -> str:
    first, skip = divmod(at, 8)
    n = -(-(skip + 12) // 8)
    total = " + ".join(f"('0x' || substr(h, 2 * (head + {first + k}) + 1, 2))::BIGINT * {256 ** (n - 1 - k)}" for k in range(n))
    return f"(({total}) // {1 << 8 * n - skip - 12} & 4095)"


_LENGTHS = " ".join(f"WHEN is_1 = {str(one).lower()} AND is_mono = {str(single).lower()} THEN {' + '.join(map(_sql_twelve, places))}" for (one, single), places in bits.LENGTH_FIELDS.items())


@query(f"""SELECT page_id, (CASE WHEN is_1 THEN ('0x' || substr(h, 2 * head + 1, 2))::BIGINT * 2 + ('0x' || substr(h, 2 * head + 3, 2))::BIGINT // 128
    ELSE ('0x' || substr(h, 2 * head + 1, 2))::BIGINT END)::INTEGER AS back, ceil((CASE {_LENGTHS} END) / 8.0)::INTEGER AS length
    FROM (SELECT page_id, hex(html) AS h, page_id % 2 = 0 AS is_1, page_id % 3 = 0 AS is_mono, CASE WHEN page_id % 5 = 0 THEN 6 ELSE 4 END AS head FROM pages)""")
def q25_main_data(spark, sf_dir):
    i = F.col("page_id")
    rows = read(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("b"), (i % 2 == 0).alias("is_1"), (i % 3 == 0).alias("is_mono"), F.when(i % 5 == 0, 6).otherwise(4).alias("head"))
    return rows.select("page_id", bits.main_data_offset(F.col("b"), F.col("is_1"), F.col("head")).cast("int").alias("back"), bits.main_data_length(F.col("b"), F.col("is_1"), F.col("is_mono"), F.col("head")).alias("length"))


_BYTES = "list_transform(range(strlen(html)), lambda i: ('0x' || substr(hex(html), 2 * i + 1, 2))::BIGINT)"
_CRC = "list_reduce(list_prepend({start}, {bytes}), lambda c, b: {step})::INTEGER"


@query("SELECT page_id, " + _CRC.format(start=0, bytes=_BYTES, step=f"xor({bits.REFLECTED}[(xor(c, b) & 255) + 1], c >> 8)") + " AS crc FROM pages")
def q08_crc16_arc(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", bits.crc16_arc(F.encode("html", "UTF-8")).alias("crc"))


@query("SELECT page_id, " + _CRC.format(start=65535, bytes=_BYTES, step=f"xor((c * 256) & 65535, {bits.STRAIGHT}[(xor(c >> 8, b) & 255) + 1])") + " AS crc FROM pages")
def q09_crc16_frame(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", bits.crc16_frame(F.encode("html", "UTF-8")).alias("crc"))


@query("""SELECT page_id, ((('0x' || substr(h, 13, 2))::BIGINT & 127) * 2097152 + (('0x' || substr(h, 15, 2))::BIGINT & 127) * 16384
    + (('0x' || substr(h, 17, 2))::BIGINT & 127) * 128 + (('0x' || substr(h, 19, 2))::BIGINT & 127))::INTEGER AS size FROM (SELECT page_id, hex(html) AS h FROM pages)""")
def q26_synchsafe(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", bits.synchsafe(F.encode("html", "UTF-8"), 6).cast("int").alias("size"))


@query("SELECT page_id, sha256(html) AS digest, count(*) OVER (PARTITION BY sha256(html)) AS n_equal FROM pages")
def q35_sha256_equal(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("digest"))
    return rows.join(rows.groupBy("digest").agg(F.count("*").alias("n_equal")), "digest").select("page_id", "digest", "n_equal")


# Frame tables


@query("""WITH f AS (SELECT user_id, (floor(value) + 24)::BIGINT AS size, row_number() OVER w - 1 AS k, coalesce(sum((floor(value) + 24)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), t AS (SELECT user_id, count(*) AS n, sum(size) AS bytes FROM f GROUP BY user_id),
    e AS (SELECT *, unnest(range(100)) AS i FROM t)
    SELECT e.user_id, e.i::INTEGER AS i, least(255, floor(256.0::DOUBLE * f.o / e.bytes))::INTEGER AS value FROM e JOIN f ON f.user_id = e.user_id AND f.k = e.n * e.i // 100""")
def q12_toc100(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", (F.floor("value") + 24).cast("long").alias("size"))
    return index.toc(index.offsets(rows, ["user_id"], ["event_id"], "size"), ["user_id"], "size")


@query("""SELECT l_orderkey, (CASE WHEN min(l_quantity::INTEGER % 3) = max(l_quantity::INTEGER % 3) THEN min(l_quantity::INTEGER % 3) ELSE 0 END)::INTEGER AS cbr FROM lineitem GROUP BY l_orderkey""")
def q18_cbr_detect(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("i", F.col("qty") % 3)
    return rows.groupBy("l_orderkey").agg(index.constant_rate("i").alias("cbr"))


_OFFSETS = f"""SELECT *, coalesce(sum(q) OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + bad AS o
    FROM (SELECT *, l_quantity::INTEGER AS q, (l_returnflag = 'R' AND l_quantity > 45)::INTEGER AS bad FROM lineitem)"""


def packets(spark, sf_dir) -> DataFrame:
    """Lines as frames with offsets, some of which are off by one."""
    rows = index.offsets(lines(spark, sf_dir), ["l_orderkey"], LINE_ORDER, "qty")
    bad = ((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).cast("int")
    return rows.withColumn("o", F.col("offset") + bad)


@query(f"""SELECT l_orderkey, count(*) AS n, count(*) FILTER (NOT linked) AS breaks, bool_and(linked) AS ok FROM (
    SELECT l_orderkey, o = coalesce(lag(o + q) OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}), 0) AS linked FROM ({_OFFSETS})) GROUP BY l_orderkey""")
def q19_chain_valid(spark, sf_dir):
    rows = index.chain_breaks(packets(spark, sf_dir), ["l_orderkey"], LINE_ORDER, "o", "qty")
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(~F.col("linked")).alias("breaks"), F.bool_and("linked").alias("ok"))


@query(f"""WITH p AS ({_OFFSETS}) SELECT a.l_orderkey, count(*) AS n, sum(a.o)::BIGINT AS places FROM p a
    WHERE EXISTS (SELECT 1 FROM p b WHERE b.l_orderkey = a.l_orderkey AND b.o + b.q = a.o) GROUP BY a.l_orderkey""")
def q41_preceded_frames(spark, sf_dir):
    return index.preceded(packets(spark, sf_dir), ["l_orderkey"], "o", "qty").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("o").alias("places"))


@query(f"""WITH p AS (SELECT *, o = coalesce(lag(o + q) OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}), 0) AS linked FROM ({_OFFSETS})),
    g AS (SELECT l_orderkey, bool_and(linked) AS ok FROM p GROUP BY 1)
    SELECT p.l_orderkey, CASE WHEN g.ok THEN 'parallel' ELSE 'serial' END AS path, count(*) AS n, sum(CASE WHEN g.ok THEN p.o ELSE p.o - p.bad END)::BIGINT AS places
    FROM p JOIN g ON p.l_orderkey = g.l_orderkey GROUP BY 1, 2""")
def q40_self_heal(spark, sf_dir):
    rows = index.chain_breaks(packets(spark, sf_dir), ["l_orderkey"], LINE_ORDER, "o", "qty")
    parallel = rows.select("l_orderkey", "linked", "o", F.lit("parallel").alias("path"))
    serial = rows.select("l_orderkey", "linked", F.col("offset").alias("o"), F.lit("serial").alias("path"))
    return index.heal(parallel, serial, ["l_orderkey"], "linked").groupBy("l_orderkey", "path").agg(F.count("*").alias("n"), F.sum("o").alias("places"))


@query("""SELECT user_id, count(*) AS frames, count(*) * 1152 - sum(floor(value)::BIGINT)::BIGINT - 576 AS padding, sum(floor(value)::BIGINT)::BIGINT AS samples FROM events GROUP BY user_id""")
def q31_padding_samples(spark, sf_dir):
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("frames"), F.sum(F.floor("value")).alias("samples"))
    return e.select("user_id", "frames", index.padding_samples(F.col("frames"), F.col("samples"), 576).alias("padding"), "samples")


@query(f"""WITH o AS (SELECT o_orderkey, (o_orderkey * 7919 % 340000)::BIGINT AS low, (o_orderkey * 104729 % 340000)::BIGINT AS high, o_orderkey % 2 = 0 AS is_1 FROM orders),
    r AS (SELECT true AS is_1, i, {_BR1}[i + 1] AS rate FROM range(1, 15) t(i) UNION ALL SELECT false, i, {_BR2}[i + 1] FROM range(1, 15) t(i))
    SELECT o_orderkey, coalesce(min(i) FILTER (rate >= low), 14)::INTEGER AS low, coalesce(max(i) FILTER (rate <= high), 1)::INTEGER AS high FROM o JOIN r ON o.is_1 = r.is_1 GROUP BY o_orderkey""")
def q30_rate_bounds(spark, sf_dir):
    k = F.col("o_orderkey")
    low, high = index.rate_indices(k * 7919 % 340000, k * 104729 % 340000, k % 2 == 0)
    return read(spark, sf_dir, "orders").select(k, low.alias("low"), high.alias("high"))


@query(f"SELECT mode::INTEGER AS mode, count(*) AS n, count(*) FILTER (NOT {_VALID}) AS errors FROM ({_FIELDS}) GROUP BY mode")
def q33_decode_errors(spark, sf_dir):
    w = F.col("w")
    return words(spark, sf_dir).groupBy(bits.mode(w).alias("mode")).agg(F.count("*").alias("n"), F.count_if(~bits.valid(w)).alias("errors"))


# Files, tags and settings


_HEX = "hex(html)"


#: Leading bytes of each kind, and some that only resemble one.
_MAGICS = [b"FORM\0\0\0\0AIFF", b"FORM\0\0\0\0AIFC", b"fLaC", b"RIFF\0\0\0\0WAVE", b"RIFF\0\0\0\0AVI ", b"ID3", b"\xff\xfb\x90", b"\xff\xdf", b"\xff\xd8\xff", b"\x89PNG\r\n\x1a\n", b"\x89PNG", b"", b"x"]


@query(f"""SELECT page_id, CASE
    WHEN h LIKE '464F524D________41494646%' THEN 'aiff' WHEN h LIKE '664C6143%' THEN 'flac' WHEN h LIKE '52494646________57415645%' AND length(h) >= 88 THEN 'wav'
    WHEN gated THEN 'mp3' WHEN h LIKE 'FFD8FF%' THEN 'image/jpeg' WHEN h LIKE '89504E470D0A1A0A%' THEN 'image/png'
    WHEN h LIKE '3C%' THEN 'html' ELSE 'other' END AS kind, gated::INTEGER AS gated FROM (
    SELECT page_id, h, h NOT LIKE '52494646________57415645%' AND (h LIKE '494433%' OR regexp_matches(h, '^FF[EF]')) AS gated FROM (
    SELECT page_id, {str([m.hex().upper() for m in _MAGICS])}[page_id % {len(_MAGICS)} + 1] || CASE WHEN page_id % 7 = 0 THEN '' ELSE hex(html) END AS h FROM pages))""")
def q02_magic_sniff(spark, sf_dir):
    i = F.col("page_id")
    head = F.get(F.array(*map(F.lit, _MAGICS)), (i % len(_MAGICS)).cast("int"))
    rows = read(spark, sf_dir, "pages").select("page_id", F.concat(head, F.when(i % 7 == 0, F.lit(b"")).otherwise(F.encode("html", "UTF-8"))).alias("b"))
    return rows.select("page_id", meta.kind_of_text(F.col("b")).alias("kind"), meta.mp3_like(F.col("b")).cast("int").alias("gated"))


@query("""SELECT page_id, estimate, CASE WHEN estimate > 16384 THEN 'refuse' WHEN estimate * 4 > 16384 * 3 THEN 'warn' ELSE 'go' END AS verdict FROM (
    SELECT page_id, floor(strlen(html) * (1.35::DOUBLE + 4::DOUBLE / 3 + 3))::BIGINT AS estimate FROM pages)""")
def q22_admission_estimate(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", meta.peak_memory(F.octet_length("html"), F.lit(24), F.lit(True)).alias("estimate"))
    return rows.withColumn("verdict", meta.admission(F.col("estimate"), 16384))


@query("SELECT page_id, CASE WHEN frames <= 512 * size THEN frames END AS frames FROM (SELECT page_id, strlen(html) AS size, page_id * 10007 % 2000000 AS frames FROM pages)")
def q39_plausible_frames(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", meta.plausible_frames(F.col("page_id") * 10007 % 2000000, F.octet_length("html")).alias("frames"))


_KEYS = ["Title", "ARTIST", "album", "Date", "comment", "TrackNumber", "genre", "encoder"]
_KEYS_SQL = "[" + ", ".join(f"'{k}'" for k in _KEYS) + "]"


@query(f"""WITH c AS (SELECT user_id, event_id, upper({_KEYS_SQL}[event_id % 8 + 1]) AS k, event_type || '-' || event_id AS v FROM events),
    t AS (SELECT user_id, {', '.join(f"arg_max(v, event_id) FILTER (k = '{k}') AS {f}" for k, f in meta.VORBIS.items())} FROM c GROUP BY user_id)
    SELECT user_id, coalesce(CASE WHEN user_id % 3 = 0 THEN 'own' WHEN user_id % 3 = 1 THEN NULL END, title) AS title, {', '.join(meta.FIELDS[1:])} FROM t""")
def q15_tag_precedence(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    names = F.array(*(F.lit(k) for k in _KEYS))
    comments = e.select("user_id", "event_id", F.get(names, (F.col("event_id") % 8).cast("int")).alias("key"), F.concat_ws("-", "event_type", "event_id").alias("value"))
    tags = meta.project_comments(comments, "user_id", "key", "value", "event_id")
    own = F.when(F.col("user_id") % 3 == 0, "own").when(F.col("user_id") % 3 == 2, "")
    return tags.select("user_id", meta.merge_tags(own, F.col("title")).alias("title"), *meta.FIELDS[1:])


@query("""SELECT source, doc_id, kind FROM (SELECT source, doc_id, (n_chars % 5)::INTEGER AS kind, row_number() OVER (PARTITION BY source ORDER BY n_chars % 5 <> 3, doc_id) AS k FROM documents) WHERE k = 1""")
def q16_cover_pick(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("source", "doc_id", (F.col("n_chars") % 5).cast("int").alias("kind"))
    return meta.pick_picture(rows, "source", "kind", "doc_id").select("source", "doc_id", "kind")


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'own' WHEN page_id % 3 = 1 THEN 'embedded' END AS origin, CASE WHEN page_id % 3 = 0 THEN 'image/png' WHEN page_id % 3 = 1 THEN 'image/jpeg' END AS mime,
    page_id % 2 = 0 OR coalesce(CASE WHEN page_id % 3 < 2 THEN strlen(html) * 100 + 8 END > 131072, false) AS v2 FROM pages""")
def q42_cover_precedence(spark, sf_dir):
    i = F.col("page_id")
    own = F.when(i % 3 == 0, F.concat(F.lit(b"\x89PNG\r\n\x1a\n"), F.encode("html", "UTF-8"))).when(i % 3 == 2, F.encode("html", "UTF-8"))
    embedded = F.concat(F.lit(b"\xff\xd8\xff"), F.encode("html", "UTF-8"))
    art = meta.cover(own, embedded)
    rows = read(spark, sf_dir, "pages").select("page_id", "html", meta.cover_type(art).alias("mime"))
    size = F.when(F.col("mime").isNotNull(), F.octet_length("html") * 100 + 8)
    return rows.select("page_id", F.when(F.col("mime").isNull(), None).when(i % 3 == 0, "own").otherwise("embedded").alias("origin"), "mime", meta.needs_v2(size, i % 2 == 0).alias("v2"))


_PRESETS = ["medium", "standard", "extreme", "insane", "128", "7", "321", "loud"]


@query(f"""SELECT event_id, name, CASE WHEN name IN ('medium', 'standard', 'extreme') THEN 'vbr' WHEN name = 'insane' THEN 'cbr' WHEN name = '128' THEN 'abr' END AS mode,
    CASE name WHEN 'medium' THEN 40 WHEN 'standard' THEN 20 WHEN 'extreme' THEN 0 WHEN 'insane' THEN 320 WHEN '128' THEN 128 END::INTEGER AS value,
    (CASE WHEN name IN ('insane', '128') AND event_id % 10 < 4 THEN 4 ELSE event_id % 10 END)::INTEGER AS quality
    FROM (SELECT event_id, {str(_PRESETS)}[event_id % 8 + 1] AS name FROM events)""")
def q27_preset_mapping(spark, sf_dir):
    name = F.get(F.array(*(F.lit(p) for p in _PRESETS)), (F.col("event_id") % 8).cast("int"))
    rows = read(spark, sf_dir, "events").select("event_id", name.alias("name")).withColumn("p", meta.preset(F.col("name")))
    return rows.select("event_id", "name", F.col("p.mode").alias("mode"), F.col("p.value").alias("value"), meta.shown_quality(F.col("p.mode"), (F.col("event_id") % 10).cast("int")).alias("quality"))


# Runs and tests


_RUNS = f"SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}, l_discount) AS run, l_quantity AS wall, l_extendedprice / 997 AS cpu, l_returnflag = 'R' AS st_fallback FROM lineitem"


@query(f"""WITH r AS ({_RUNS}), m AS (SELECT *, NOT st_fallback AND NOT (count(*) OVER w > 1 AND run = 1) AS counts, run = max(run) OVER w AS is_last FROM r WINDOW w AS (PARTITION BY l_orderkey)),
    a AS (SELECT *, bool_or(counts) OVER (PARTITION BY l_orderkey) AS has_any FROM m), v AS (SELECT * FROM a WHERE counts OR (NOT has_any AND is_last)),
    b AS (SELECT l_orderkey, count(*) AS n_runs, min(wall) AS wall_min, median(wall) AS wall_med, avg(wall) AS wall_mean, arg_min(cpu, (wall, run)) AS best_cpu, bool_or(NOT has_any AND st_fallback) AS is_fallback FROM v GROUP BY 1)
    SELECT l_orderkey, n_runs, wall_min, round(wall_med, 6) AS wall_med, round(wall_mean, 6) AS wall_mean, best_cpu, is_fallback,
    round(CASE WHEN wall_min > 0 THEN 240 / wall_min ELSE 0 END, 6) AS play_wall, round(CASE WHEN best_cpu > 0 THEN 240 / best_cpu ELSE 0 END, 6) AS play_cpu,
    round(CASE WHEN wall_min > 0 THEN best_cpu / wall_min ELSE 0 END, 6) AS par_eff, round(CASE WHEN wall_min > 0 THEN 100 * best_cpu / (wall_min * 8) ELSE 0 END, 6) AS par_eff_pct FROM b""")
def q14_bench_stats(spark, sf_dir):
    run = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER, "l_discount"))
    rows = lines(spark, sf_dir).select("l_orderkey", run.alias("run"), F.col("l_quantity").alias("wall"), (F.col("l_extendedprice") / 997).alias("cpu"), (F.col("l_returnflag") == "R").alias("st_fallback"))
    out = runs.bench_stats(rows, ["l_orderkey"], 240.0, 8)
    return out.withColumns({c: F.round(c, 6) for c in ("wall_med", "wall_mean", "play_wall", "play_cpu", "par_eff", "par_eff_pct")})


@query("SELECT event_id, round(CASE WHEN event_id % 4 = 0 THEN 0 ELSE value END + value / 10 + 1.5::DOUBLE, 6) AS total FROM events")
def q32_stage_total(spark, sf_dir):
    v = F.col("value")
    return read(spark, sf_dir, "events").select("event_id", F.round(runs.stage_total(v, v / 10, F.lit(1.5), F.col("event_id") % 4 == 0), 6).alias("total"))


@query("""SELECT a.user_id, abs(a.n - b.n) * 1152 / 44100::DOUBLE <= 1.0::DOUBLE AS within FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) a
    JOIN (SELECT user_id, count(*) FILTER (event_id % 50 <> 0) AS n FROM events GROUP BY 1) b ON a.user_id = b.user_id""")
def q34_duration_tolerance(spark, sf_dir):
    seconds = F.abs(F.count("*") - F.count_if(F.col("event_id") % 50 != 0)) * 1152 / 44100.0
    return read(spark, sf_dir, "events").groupBy("user_id").agg((seconds <= 1.0).alias("within"))


@query("""WITH b AS (SELECT l_linenumber AS threads, min(l_extendedprice) AS best FROM lineitem GROUP BY 1), a AS (SELECT arg_min(best, threads) AS base FROM b)
    SELECT threads, best, round(base / best, 6) AS speedup, round(240 / best, 6) AS realtime, round(100 * base / best / threads, 6) AS efficiency FROM b, a""")
def q37_scaling(spark, sf_dir):
    times = read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("threads"), "l_extendedprice")
    out = runs.scaling(times, "threads", "l_extendedprice", 240.0)
    return out.withColumns({c: F.round(c, 6) for c in ("speedup", "realtime", "efficiency")})


@query("SELECT outcome, count(*) AS n FROM (SELECT CASE l_linenumber WHEN 1 THEN 'ok' WHEN 2 THEN 'handled' ELSE 'crash' END AS outcome FROM lineitem) GROUP BY outcome")
def q38_crash_buckets(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy(runs.outcome(F.col("l_linenumber") - 1).alias("outcome")).agg(F.count("*").alias("n"))


# Readers: files made of the tables' rows


def wav_files(spark, sf_dir) -> DataFrame:
    """A 16-bit mono WAV file for each page, whose samples are the page's bytes."""
    size = F.octet_length("html")
    le = lambda n, width: F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(width))))
    body = F.encode("html", "UTF-8")
    even = size - size % 2
    head = F.concat(F.lit(b"RIFF"), le(even + 36, 4), F.lit(b"WAVEfmt \x10\0\0\0\x01\0\x01\0\x44\xac\0\0\x88\x58\x01\0\x02\0\x10\0data"), le(even, 4))
    return read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.concat(head, body).alias("content"))


@query("""SELECT page_id::VARCHAR AS path, 'wav' AS container, 44100::INTEGER AS rate, 1::INTEGER AS channels, 16::INTEGER AS bits, (strlen(html) // 2)::BIGINT AS n_frames FROM pages""")
def q43_wav_clips(spark, sf_dir):
    return audio.clips(wav_files(spark, sf_dir)).select("path", "container", "rate", "channels", "bits", "n_frames")


@query("""SELECT page_id::VARCHAR AS path, i AS frame, (CASE WHEN v > 32767 THEN v - 65536 ELSE v END)::INTEGER AS s16 FROM (
    SELECT page_id, i, ('0x' || substr(h, 4 * i + 3, 2))::BIGINT * 256 + ('0x' || substr(h, 4 * i + 1, 2))::BIGINT AS v FROM (SELECT page_id, hex(html) AS h, unnest(range(strlen(html) // 2)) AS i FROM pages))""")
def q44_wav_samples(spark, sf_dir):
    return audio.samples(wav_files(spark, sf_dir)).select("path", "frame", F.col("s16").cast("int").alias("s16"))


_ENDED = "CASE WHEN user_id % 3 = 0 THEN 10 ELSE 0 END"
_PARTS = f"""SELECT *, user_id % 7 + coalesce(sum(size) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place,
    sum(gap::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id) AS gaps, user_id % 7 + sum(size) OVER (PARTITION BY user_id) AS total FROM (
    SELECT user_id, f.*, event_id % 50 = 0 AS gap, CASE WHEN event_id % 50 = 0 THEN 4 ELSE frame_size END AS size, event_id % 200 AS c,
    header_len + CASE WHEN mode = 3 THEN (CASE WHEN mono THEN 17 ELSE 32 END) ELSE (CASE WHEN mono THEN 9 ELSE 17 END) END AS info
    FROM ({_FIELDS}) f JOIN events e USING (event_id)) WHERE gap OR ({_VALID} AND frame_size >= 40)"""


def mp3_files(spark, sf_dir, cut: bool) -> DataFrame:
    """A file for each user: some zeros, then its events' frames, each a header word and bytes of one value; an event in 50
    is a gap of four zeros instead. Every third file lacks its last ten bytes, if cut."""
    w, i = F.col("w"), F.col("event_id")
    hexed = lambda n, width: F.lpad(F.hex(n), width, "0")
    rows = words(spark, sf_dir).join(read(spark, sf_dir, "events").select("event_id", "user_id"), "event_id").withColumn("size", bits.frame_size(w))
    gap = i % 50 == 0
    rows = rows.filter(gap | (bits.valid(w) & (F.col("size") >= 40)))
    part = F.when(gap, F.lit("00000000")).otherwise(F.concat(hexed(w, 8), F.repeat(hexed(i % 200, 2), (F.col("size") - 4).cast("int"))))
    files = rows.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", part.alias("part")))), lambda x: x["part"]), "").alias("h"))
    content = F.unhex(F.concat(F.repeat(F.lit("00"), (F.col("user_id") % 7).cast("int")), "h"))
    short = F.when(F.col("user_id") % 3 == 0, F.expr("substring(content, 1, greatest(0, length(content) - 10))")).otherwise(F.col("content"))
    files = files.select(F.col("user_id"), content.alias("content"))
    return files.select(F.col("user_id").cast("string").alias("path"), (short if cut else F.col("content")).alias("content"))


@query(f"""WITH o AS (SELECT *, total - {_ENDED} AS len, min(gaps) FILTER (NOT gap) OVER (PARTITION BY user_id) AS chain FROM ({_PARTS})),
    f AS (SELECT * FROM o WHERE NOT gap AND gaps = chain AND place + 4 <= len)
    SELECT user_id::VARCHAR AS path, (row_number() OVER (PARTITION BY user_id ORDER BY place) - 1)::INTEGER AS k, place::BIGINT AS "offset", size::INTEGER AS size, mode::INTEGER AS mode,
    max(place + size) OVER (PARTITION BY user_id) + 4 > len AS whole, max(place + size) OVER (PARTITION BY user_id) > len AS truncated FROM f""")
def q46_frame_scan(spark, sf_dir):
    """The chain of frames of files with leading junk, gaps that end it, and truncated tails."""
    return audio.frames(mp3_files(spark, sf_dir, True)).select("path", "k", "offset", "size", "mode", "whole", "truncated")


_PACKED = "CASE WHEN mode = 3 AND NOT mono THEN (c % 16) * 256 + c + (c % 2) * 2048 + c * 8 + c // 32 + (c % 64) * 64 + c // 4 + (c % 8) * 512 + c * 2 + c // 128 WHEN mode = 3 THEN (c % 64) * 64 + c // 4 + (c % 8) * 512 + c * 2 + c // 128 WHEN mono THEN (c % 128) * 32 + c // 8 ELSE (c % 64) * 64 + c // 4 + (c % 128) * 32 + c // 8 END"


@query(f"""WITH p AS (SELECT *, size - info AS body, CASE WHEN mode = 3 THEN c * 2 + c // 128 ELSE c END AS back, ceil(({_PACKED}) / 8e0)::BIGINT AS need FROM ({_PARTS}) WHERE NOT gap),
    o AS (SELECT *, row_number() OVER w - 1 AS k, sum(body) OVER w - body AS start, sum(body * c) OVER w - body * c AS before, min(br_idx) OVER w AS lo, max(br_idx) OVER w AS hi FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    q AS (SELECT *, greatest(0, start - back) AS a, greatest(0, least(start + body, start - back + need)) AS b FROM o),
    s AS (SELECT user_id, start, before, c FROM o WHERE body > 0),
    x AS (SELECT q.*, coalesce(s.before + s.c * (q.a - s.start), 0) AS upto_a FROM q ASOF LEFT JOIN s ON q.user_id = s.user_id AND q.a >= s.start),
    y AS (SELECT x.*, coalesce(s.before + s.c * (x.b - s.start), 0) AS upto_b FROM x ASOF LEFT JOIN s ON x.user_id = s.user_id AND x.b >= s.start),
    z AS (SELECT *, CASE WHEN lo = hi THEN lo ELSE 0 END AS shared FROM y)
    SELECT user_id::VARCHAR AS path, k::INTEGER AS k, greatest(info + need, size)::INTEGER AS length, shared::INTEGER AS br_idx,
    (w // 16777216 + w // 65536 % 256 + (w // 256 % 16 + shared * 16) + w % 256 + (info - 5) * c - CASE WHEN mode = 3 THEN c // 128 * 128 ELSE 0 END + greatest(0, upto_b - upto_a))::BIGINT AS total FROM z""")
def q47_unpack_packets(spark, sf_dir):
    """Packets with their own main data: their lengths, bit-rate indices and sums of bytes."""
    rows = audio.unpack(mp3_files(spark, sf_dir, False)).withColumn("h", F.hex("packet"))
    byte = lambda i: F.conv(F.substring(F.col("h"), 2 * i + 1, F.lit(2)), 16, 10).cast("long")
    total = F.aggregate(F.sequence(F.lit(0), F.length("packet") - 1), F.lit(0).cast("long"), lambda t, i: t + byte(i))
    return rows.select("path", "k", F.length("packet").alias("length"), F.floor(byte(F.lit(2)) / 16).cast("int").alias("br_idx"), total.alias("total"))


def _number(n, width: int, little: bool = True):
    """A number's bytes."""
    return F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in (range(width) if little else reversed(range(width))))))


def aiff_files(spark, sf_dir) -> DataFrame:
    """A mono AIFF file for each page, of 16 bits for even and 24 for odd ones, whose samples are the page's bytes."""
    i, size = F.col("page_id"), F.octet_length("html")
    width = F.when(i % 2 == 0, 2).otherwise(3)
    n = F.floor(size / width).cast("int")
    head = F.concat(F.lit(b"FORM"), _number(size + 46, 4, False), F.lit(b"AIFFCOMM\0\0\0\x12\0\x01"), _number(n, 4, False), _number(width * 8, 2, False), F.lit(b"\x40\x0e\xac\x44" + bytes(6)), F.lit(b"SSND"), _number(size + 8, 4, False), F.lit(bytes(8)))
    return read(spark, sf_dir, "pages").select(i.cast("string").alias("path"), F.concat(head, F.encode("html", "UTF-8")).alias("content"))


@query("""SELECT page_id::VARCHAR AS path, i AS frame, CASE WHEN width = 2 THEN (CASE WHEN v > 32767 THEN v - 65536 ELSE v END)::INTEGER END AS s16,
    CASE WHEN width = 3 THEN round((CASE WHEN v > 8388607 THEN v - 16777216 ELSE v END) / 8388608e0, 9) END AS f32 FROM (
    SELECT page_id, width, i, ('0x' || substr(h, 2 * width * i + 1, 2 * width))::BIGINT AS v FROM (
    SELECT page_id, 2 + page_id % 2 AS width, hex(html) AS h, unnest(range(strlen(html) // (2 + page_id % 2))) AS i FROM pages))""")
def q48_aiff_samples(spark, sf_dir):
    return audio.samples(aiff_files(spark, sf_dir)).select("path", "frame", F.col("s16").cast("int").alias("s16"), F.round(F.col("f32").cast("double"), 9).alias("f32"))


@query("""SELECT page_id::VARCHAR AS path, (44100 + page_id % 3)::INTEGER AS rate, (1 + page_id % 2)::INTEGER AS channels, (CASE WHEN page_id % 11 = 0 THEN NULL ELSE 16 + page_id % 9 END)::INTEGER AS bits,
    page_id + 1 AS frames, 'Page ' || page_id AS title, (page_id % 5)::INTEGER AS kind, 4::BIGINT AS picture, page_id % 11 = 0 AS refused FROM pages""".replace("(44100 + page_id % 3)::INTEGER", "CASE WHEN page_id % 11 <> 0 THEN (44100 + page_id % 3)::INTEGER END").replace("(1 + page_id % 2)::INTEGER", "CASE WHEN page_id % 11 <> 0 THEN (1 + page_id % 2)::INTEGER END").replace("page_id + 1 AS frames, 'Page ' || page_id AS title, (page_id % 5)::INTEGER AS kind, 4::BIGINT", "CASE WHEN page_id % 11 <> 0 THEN page_id + 1 END AS frames, CASE WHEN page_id % 11 <> 0 THEN 'Page ' || page_id END AS title, CASE WHEN page_id % 11 <> 0 THEN (page_id % 5)::INTEGER END AS kind, CASE WHEN page_id % 11 <> 0 THEN 4::BIGINT END"))
def q49_flac_metadata(spark, sf_dir):
    """Stream info, the last title and the picture of FLAC files, an eleventh of which claim 25 bits and are refused."""
    i = F.col("page_id")
    depth = F.when(i % 11 == 0, 25).otherwise(16 + i % 9)
    packed = F.shiftleft((44100 + i % 3).cast("long"), 44) + F.shiftleft((i % 2).cast("long"), 41) + F.shiftleft((depth - 1).cast("long"), 36) + i + 1
    comment = lambda text: F.concat(_number(F.octet_length(text), 4), F.encode(text, "UTF-8"))
    comments = F.concat(F.lit(bytes(4) + b"\x03\0\0\0"), comment(F.lit("title=first")), comment(F.lit("no separator")), comment(F.concat(F.lit("Title=Page "), i.cast("string"))))
    picture = F.concat(_number((i % 5).cast("int"), 4, False), F.lit(b"\0\0\0\x09image/png" + bytes(4) + bytes(16) + b"\0\0\0\x04\x89PNG"))
    block = lambda kind, body: F.concat(_number(F.lit(kind), 1), _number(F.octet_length(body), 3, False), body)
    content = F.concat(F.lit(b"fLaC"), block(0, F.concat(F.lit(bytes(10)), _number(packed, 8, False), F.lit(bytes(16)))), block(4, comments), block(0x86, picture), F.encode("html", "UTF-8"))
    found = audio.flac_metadata(read(spark, sf_dir, "pages").select(i.cast("string").alias("path"), content.alias("content")))
    title = F.get(F.transform(F.filter("comments", lambda c: F.upper(c["key"]) == "TITLE"), lambda c: c["value"]), F.size(F.filter("comments", lambda c: F.upper(c["key"]) == "TITLE")) - 1)
    return found.select("path", "rate", "channels", "bits", "frames", title.alias("title"), F.get("pictures", F.lit(0))["kind"].alias("kind"), F.length(F.get("pictures", F.lit(0))["data"]).cast("long").alias("picture"), F.col("error").isNotNull().alias("refused"))


def _sql_bytes(n: str, width: int) -> str:
    """A number's bytes in hex, the lowest first."""
    return " || ".join(f"substr(lpad(hex({n}), {2 * width}, '0'), {2 * (width - k) - 1}, 2)" for k in range(width))


_EVEN = "(strlen(html) // 2 * 2)"


@query(f"""SELECT page_id || '.wav' AS name, ({_EVEN} + 44)::BIGINT AS length, sha256(unhex('52494646' || {_sql_bytes(f"{_EVEN} + 36", 4)} || hex('WAVEfmt ') || '10000000010001004' || '4AC0000' || '88580100' || '02001000' || hex('data')
    || {_sql_bytes(_EVEN, 4)} || substr(hex(html), 1, 2 * {_EVEN}))) AS sha256 FROM pages""")
def q50_wav_files(spark, sf_dir):
    """WAV files rendered from samples, written by tasks into a shared folder, and read from there as bytes."""
    folder = audio.scratch_folder(spark)
    made = audio.wav_contents(audio.samples(wav_files(spark, sf_dir)), 44100)
    audio.write_files(made.select(F.concat("path", F.lit(".wav")).alias("name"), "content"), folder)
    return audio.read_files(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def _sql_frame(key: str, text: str) -> str:
    return f"'{key.encode().hex()}' || '000000' || lpad(hex(strlen({text}) + 1), 2, '0') || '0000' || '03' || hex({text})"


_TAG = " || ".join((_sql_frame("TIT2", "'Page ' || page_id"), _sql_frame("TPE1", "'A'"), _sql_frame("TDRC", "'2024'"), _sql_frame("TRCK", "(page_id % 300)::VARCHAR")))


@query(f"""SELECT page_id, (length(h) // 2)::INTEGER AS length, sha256(unhex(h)) AS sha256 FROM (SELECT page_id, '494433' || '04000000' || '0000' || lpad(hex(length(tag) // 2), 2, '0') || tag || hex(html)
    || hex('TAG') || rpad(hex('Page ' || page_id), 60, '0') || rpad('41', 60, '0') || repeat('00', 30) || hex('2024') || repeat('00', 28) || '00'
    || lpad(hex(CASE WHEN page_id % 300 < 256 THEN page_id % 300 ELSE 0 END), 2, '0') || 'FF' AS h FROM (SELECT page_id, html, {_TAG} AS tag FROM pages))""")
def q51_mp3_assembly(spark, sf_dir):
    """Files of both tags around a stream of bytes."""
    i, none = F.col("page_id"), F.lit(None).cast("string")
    rows = read(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("body"), F.concat(F.lit("Page "), i.cast("string")).alias("title"), F.lit("A").alias("artist"), none.alias("album"), F.lit("2024").alias("year"), none.alias("comment"), (i % 300).cast("string").alias("track"), none.alias("genre"))
    return audio.assemble_mp3(audio.with_tags(rows)).select("page_id", F.length("content").alias("length"), F.sha2("content", 256).alias("sha256"))


@query("""SELECT l_orderkey, count(*) AS frames, 0::BIGINT AS last_chunk, sum(qty)::BIGINT AS total FROM (SELECT l_orderkey, l_quantity::INTEGER AS qty FROM lineitem) GROUP BY l_orderkey HAVING count(*) < 8""")
def q52_tiny_streams(spark, sf_dir):
    """Streams of fewer frames than the overlap of frames of 576 samples: one chunk holds them, each frame stays once."""
    overlap = chunks.overlap_for(576)
    rows = lines(spark, sf_dir).withColumn("frame", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)).cast("long") - 1)
    kept = chunks.discard_overlap(chunks.explode_chunks(rows, "frame", overlap=overlap), overlap)
    return kept.groupBy("l_orderkey").agg(F.count("*").alias("frames"), F.max("chunk_id").alias("last_chunk"), F.sum("qty").cast("long").alias("total")).filter(F.col("frames") < overlap)


_OPTIONS = ["-b 160", "-V 2", "--abr 128", "--preset insane", "--preset 96", "-q3", "-mj", "-V", "--tt Song", "-bogus"]
_PICK = [f"{str(_OPTIONS)}[event_id // {n} % {len(_OPTIONS)} + 1]" for n in (1, 10, 100)]
_LAST = "list_last(list_filter([a, b, c], lambda x: x IN ({})))"


@query(f"""WITH o AS (SELECT event_id, {', '.join(f"{x} AS {n}" for x, n in zip(_PICK, 'abc'))} FROM events),
    m AS (SELECT *, {_LAST.format("'-b 160', '-V 2', '--abr 128', '--preset insane', '--preset 96'")} AS m, {_LAST.format("'-b 160', '--preset insane'")} AS rate,
        {_LAST.format("'--abr 128', '--preset 96'")} AS mean, a IN ('-V', '-bogus') OR b IN ('-V', '-bogus') OR c IN ('-V', '-bogus') AS bad FROM o)
    SELECT event_id, bad, CASE WHEN NOT bad THEN CASE WHEN m = '-V 2' THEN 'vbr' WHEN m IN ('--abr 128', '--preset 96') THEN 'abr' ELSE 'cbr' END END AS mode,
    CASE WHEN NOT bad THEN CASE rate WHEN '-b 160' THEN 160 WHEN '--preset insane' THEN 320 ELSE 192 END END::INTEGER AS bitrate,
    CASE WHEN NOT bad THEN CASE mean WHEN '--abr 128' THEN 128 WHEN '--preset 96' THEN 96 ELSE 192 END END::INTEGER AS abr,
    CASE WHEN NOT bad THEN CASE WHEN '-V 2' IN (a, b, c) THEN 20 ELSE 40 END END::INTEGER AS vbr,
    CASE WHEN NOT bad THEN CASE WHEN '-q3' IN (a, b, c) THEN 3 ELSE -1 END END::INTEGER AS quality,
    CASE WHEN NOT bad THEN CASE WHEN '-mj' IN (a, b, c) THEN 'joint' ELSE 'auto' END END AS stereo,
    CASE WHEN NOT bad AND '--tt Song' IN (a, b, c) THEN 'Song' END AS title FROM m""")
def q53_options(spark, sf_dir):
    """Lines of three options each; a value that is missing or no number is an error."""
    picks = [F.get(F.array(*map(F.lit, _OPTIONS)), (F.floor(F.col("event_id") / n) % len(_OPTIONS)).cast("int")) for n in (1, 10, 100)]
    rows = read(spark, sf_dir, "events").select("event_id", F.concat_ws(" ", F.lit("in.wav"), *picks).alias("line"))
    parsed = options.parse_lines(rows, "line")
    return parsed.select("event_id", F.col("error").isNotNull().alias("bad"), "mode", "bitrate", "abr", "vbr", "quality", "stereo", "title")
