"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.llm import common

#: Lines of at least so many words may match with one word inserted, deleted or replaced; shorter ones exactly, as one word
#: in a few is another statement rather than a copy. The parameter min_words takes any other number from 2 on; at 1, where
#: every line of one word would be near every other, matches of such lines are not all found, so that is an error.
MIN_WORDS = 8

#: Bytes up to which the list of dropped lines (eight a line, some 64 a document) is broadcast; beyond that it meets the
#: texts in a shuffle.
BROADCAST_BYTES = 16 << 20

#: Bytes of a row of key groups as Spark broadcasts it: two keys, a place, and two structs of two numbers each.
_GROUP_BYTES = 128


def _form(line: Column) -> Column:
    """What of a line is compared: all but space, tab and carriage return at its ends."""
    return F.btrim(line, F.lit(" \t\r"))


def _words(form: Column) -> Column:
    return F.split(form, " ")


def _near(a: Column, b: Column) -> Column:
    """Word edit distance of two arrays is at most one, their lengths being equal or one apart."""
    long, short = F.when(F.size(a) >= F.size(b), a).otherwise(b), F.when(F.size(a) >= F.size(b), b).otherwise(a)
    differ = F.coalesce(F.array_position(F.zip_with(long, short, lambda x, y: ~x.eqNullSafe(y)), True), F.lit(0))
    at = F.when(differ == 0, F.size(long)).otherwise(differ).cast("int")
    skip = lambda words, n: F.slice(words, n + 1, F.greatest(F.lit(0), F.size(words) - n))
    return F.when(F.size(a) == F.size(b), skip(long, at) == skip(short, at)).when(F.size(long) == F.size(short) + 1, skip(long, at) == skip(short, at - 1)).otherwise(False)


def dropped_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Lines of docs(doc_id, text) that repeat an earlier one: doc_id, n (place in the text, from 0), h (hash of the line).

    Lines go by (doc_id, n). A line is dropped if an earlier one is equal, or if both have min_words words or more and
    the earlier one is within one word edit; a dropped line drops others all the same, so the outcome doesn't hang on
    any order of work. Lines that are blank, and null or empty texts, drop nothing and aren't dropped. Rows that repeat
    a doc_id are one document: equal lines at one place don't drop each other. A null doc_id comes before all others.

    Every distinct line emits, as 128-bit keys, its variants with one word deleted: with the place of the deletion they
    join lines that differ in a word there, without it a line and one that has a word more. Each key keeps only its
    earliest line, so a group of any size costs one row a member and no pairs; the pairs kept are then verified.
    Variants are emitted only for lines that share their first or last half with another line, as lines within one edit
    do, and only of the other half. That loses no match.
    """
    if min_words < 2:
        raise ValueError("lines of one word have no neighbourhood: min_words must be 2 or more")
    docs = common.only(docs, doc_id="long", text="string")
    raw = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    forms = raw.select("doc_id", "n", _form(F.col("line")).alias("form")).filter(F.length("form") > 0)
    words, size = F.col("words"), F.size("words")
    forms = forms.withColumn("words", _words(F.col("form")))

    def half(side: str, m: Column) -> Column:
        part = F.slice(words, 1, m) if side == "l" else F.slice(words, size - m + 1, m)
        return F.xxhash64(F.lit(side), m, part)

    m1, m2 = F.floor(size / 2).cast("int"), F.floor((size - 1) / 2).cast("int")
    long_enough = size >= min_words
    keys = [F.when(long_enough, half(s, m)).alias(f"{s}{k}") for k, m in ((1, m1), (2, m2)) for s in "lr"]
    lines = forms.select("doc_id", "n", F.xxhash64("form").alias("h"), F.xxhash64(F.lit(1), "form").alias("g"), F.when(long_enough, size).alias("size"), *keys)
    lines = common.keep(lines, "lines")
    place = F.struct("doc_id", "n")
    distinct = lines.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last"), *(F.first(c).alias(c) for c in ("size", "l1", "r1", "l2", "r2")))
    distinct = common.keep(distinct, "distinct")

    # Exact repeats: of lines that occur at more than one place, all but the first.
    several = distinct.filter("first <> last").select(F.col("h").alias("h2"), F.col("g").alias("g2"), "first")
    repeats = lines.join(common.small(several), (F.col("h") == F.col("h2")) & (F.col("g") == F.col("g2"))).filter(place != F.col("first")).select("doc_id", "n", "h")

    # Lines that share a half with another.
    w = F.col("size")
    sides = [F.struct(F.col(f"{s}{k}").alias("key"), F.lit(s).alias("side"), F.floor((w - (k - 1)) / 2).cast("int").alias("m")) for k in (1, 2) for s in "lr"]
    halves = distinct.filter("size is not null").select("h", "g", "first", F.explode(F.array_distinct(F.array(*sides))).alias("x")).select("h", "g", "first", "x.*")
    shared = halves.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select("key")
    shared = common.keep(shared, "halves")
    cand = common.keep(halves.join(common.small(shared), "key"), "candidates")
    n_cand = cand.count()
    if not n_cand:
        return repeats.distinct()

    asked = cand.select("first").distinct().select(F.col("first.doc_id").alias("c_id"), F.col("first.n").alias("c_n"))
    text = docs.join(common.small(asked, n_cand), docs["doc_id"].eqNullSafe(asked["c_id"])).select("c_id", "c_n", _form(F.get(F.split("text", "\n"), F.col("c_n"))).alias("form"))
    text = text.filter("form is not null").select("c_id", "c_n", F.xxhash64("form").alias("t_h"), F.xxhash64(F.lit(1), "form").alias("t_g"), _words(F.col("form")).alias("words")).dropDuplicates(["t_h", "t_g"])
    text = common.keep(text, "texts")
    cand = cand.join(text, (F.col("h") == F.col("t_h")) & (F.col("g") == F.col("t_g")))
    rest = F.when(F.col("side") == "l", F.slice("words", F.col("m") + 1, F.size("words") - F.col("m"))).otherwise(F.slice("words", 1, F.size("words") - F.col("m")))
    variants = cand.select("h", "g", "first", "key", "side", rest.alias("rest")).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("rest"))))
    cut = F.when(F.col("i") == 0, F.col("rest")).otherwise(F.concat(F.slice("rest", 1, F.greatest(F.col("i") - 1, F.lit(0))), F.slice("rest", F.col("i") + 1, F.size("rest") - F.col("i"))))
    variants = variants.select("h", "g", "first", (F.col("i") == 0).alias("whole"), F.explode(F.when(F.col("i") == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.col("i")))).alias("p"), F.xxhash64("key", "side", cut).alias("x"), F.xxhash64(F.lit(1), "key", "side", cut).alias("y"))
    # p is the deletion's place, at which two lines differ in a word; at 0 a whole line meets one that has a word more.
    groups = variants.groupBy("x", "y", "p").agg(F.min(F.when(F.col("whole"), F.col("first"))).alias("of_whole"), F.min(F.when(~F.col("whole"), F.col("first"))).alias("of_cut"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    groups = common.keep(groups.filter("lo <> hi").drop("lo", "hi"), "groups")
    partner = F.when((F.col("p") > 0) | F.col("whole"), F.col("of_cut")).otherwise(F.col("of_whole"))
    pairs = variants.join(common.small(groups, groups.count() * (_GROUP_BYTES // 64)), ["x", "y", "p"]).select("h", "g", "first", partner.alias("earlier")).filter(F.col("earlier") < F.col("first")).distinct()
    own = text.select(F.col("t_h").alias("h"), F.col("t_g").alias("g"), F.col("words").alias("a"))
    other = text.select("c_id", "c_n", F.col("words").alias("b"))
    pairs = pairs.join(own, ["h", "g"]).join(other, F.col("earlier.doc_id").eqNullSafe(F.col("c_id")) & (F.col("earlier.n") == F.col("c_n")))
    near = pairs.filter(_near(F.col("a"), F.col("b"))).select(F.col("first.doc_id").alias("doc_id"), F.col("first.n").alias("n"), "h")
    return repeats.unionByName(near).distinct()


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the lines of dropped_lines() cut from text, and two columns: n_lines and n_kept (lines that aren't blank).

    The other lines stay as they are, blank ones too, in their order; a text that loses all its lines becomes empty.
    Null stays null with counts of 0. Other columns and rows stay, repeated rows each for itself; columns of docs that
    are named like the two counts are left out.
    """
    names = docs.columns
    code = lambda n, h: F.shiftleft(n.cast("long"), 32).bitwiseOR(h.bitwiseAND(F.lit((1 << 32) - 1)))
    drops = dropped_lines(docs, min_words).groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set(code(F.col("n"), F.col("h"))).alias("__drops"))
    drops = common.keep(drops, "drops")
    docs = common.guarded(docs, "doc_id", "text")
    n_docs, n_lines = drops.agg(F.count("*"), F.sum(F.size("__drops"))).first()
    hint = F.broadcast(drops) if 64 * n_docs + 8 * (n_lines or 0) <= BROADCAST_BYTES else drops
    joined = docs.join(hint, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left")
    rows = F.split(F.col("text").cast("string"), "\n")
    # A line's place in front of 32 bits of its hash; what array_except() leaves, in order, are the places that stay.
    codes = F.transform("__rows", lambda line, n: code(n, F.xxhash64(_form(line))))
    left = F.transform(F.array_except(codes, F.col("__drops")), lambda c: F.get(F.col("__rows"), F.shiftrightunsigned(c, 32).cast("int")))
    counted = lambda rows: F.coalesce(F.size(F.filter(rows, lambda line: F.length(_form(line)) > 0)), F.lit(0)).cast("long")
    some = F.col("__drops").isNotNull()
    # Each explode() of one element keeps what it makes from being worked out again wherever it is used.
    out = joined.withColumn("__rows", F.explode(F.array(rows)))
    out = out.withColumn("__found", F.explode(F.array(F.struct(F.when(some, left).alias("left"), counted(F.col("__rows")).alias("n")))))
    cut = F.when(some, F.size("__rows") - F.size("__found.left")).otherwise(F.lit(0))  # lines that are cut are never blank
    out = out.withColumn("n_lines", F.col("__found.n")).withColumn("n_kept", F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(F.col("__found.n") - cut))
    out = out.withColumn("__kept", F.when(some, F.array_join("__found.left", "\n")).otherwise(F.col("text")))
    stay = [k for k, c in enumerate(names) if c.lower() not in ("n_lines", "n_kept")]
    out = out.select(*(F.col("__kept" if docs.columns[k] == "text" else docs.columns[k]).alias(f"__c{k}") for k in stay), "n_lines", "n_kept")
    return out.toDF(*(names[k] for k in stay), "n_lines", "n_kept")
