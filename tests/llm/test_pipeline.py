import re
from collections import defaultdict

from test_dedup_and_shards import plain_lines
from test_models_and_search import KINDS, plain_pii
from test_ngram_join import brute
from test_tokens import JSON, check_packing
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from conftest_llm import EDGE, SMALL
from wavemill.llm import common, quality


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_each_stage_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert len(names) == 5
    out, before = {}, docs
    for name, stage in pipeline.STAGES:
        out[name] = common.keep(stage(spark, before, SMALL), "test")
        if name != names[-1]:
            assert out[name].columns == docs.columns
            assert out[name].filter("n_chars <> length(text)").count() == 0
        before = out[name]
    a, b, c, d, e = (out[n] for n in names)

    model = quality.train(docs, labels)
    assert set(texts(a)) == {i for i, t in texts(docs).items() if quality.score([t.encode()], model)[0] >= quality.THRESHOLD}

    rows = texts(a)
    gone = plain_lines(sorted(rows.items()))
    want = {}
    for i, t in rows.items():
        lines = t.split("\n")
        kept = [x for n, x in enumerate(lines) if (i, n) not in gone]
        if any(x.strip(" \t\r") for x in kept) or not any(x.strip(" \t\r") for x in lines):
            want[i] = "\n".join(kept)
    assert texts(b) == want

    groups = brute(sorted(want.items()), 5, 80, 100)
    assert texts(c) == {i: t for i, t in want.items() if groups[i][1] == i}

    for i, t in texts(c).items():
        end, clean = 0, ""
        for s, k, f in plain_pii(t):
            if s >= end or not end:
                clean += t[end:s] + f"<{KINDS[k].upper()}>"
            end = max(end, f)
        assert texts_of(d)[i] == clean + t[end:]
    library = Tokenizer.from_file(JSON)
    library.encode_special_tokens = True
    check_packing(e.collect(), sorted(texts(d).items()), lambda t: library.encode(t, add_special_tokens=False).ids)


_seen: dict = defaultdict(dict)


def texts_of(df):
    if id(df) not in _seen:
        _seen[id(df)] = texts(df)
    return _seen[id(df)]


def test_run_is_registered(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is pipeline.run
    rows = pipeline.run(spark, SMALL)
    assert {"doc_id", "sequence_id", "offset"} <= set(rows.columns) and (n := rows.count()) > 0
    pipeline.STAGES[0][1](spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL)
    assert rows.count() == n  # another run's beginning leaves this one's result
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in entry.queries() if n.startswith("op")} == set(range(1, 11))


def test_every_stage_takes_edge_rows(spark, edge, nothing):
    from pyspark.sql import functions as F

    clashing = edge.withColumn("n_chars", F.length(edge["lang"])).withColumn("stays", F.lit(1)).withColumn("rank", F.lit(2)).withColumn("salt", F.lit(3))
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipeline.STAGES:
        out = stage(spark, clashing, SMALL)
        rows = out.collect()
        if name != "best-fit packing":
            assert out.columns == clashing.columns
            assert all(r[0] in {e[0] for e in EDGE} for r in rows)
        assert rows
        assert stage(spark, empty, SMALL).count() == 0


def test_equal_rows_leave_one(spark):
    rows = [(7, "a b c d e f g"), (7, "a b c d e f g"), (7, "other words than those, all of them"), (8, "A b c d e f g"), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from wavemill.llm import ngram_join

    assert sorted(map(str, map(tuple, ngram_join.one_each(df).collect()))) == sorted(map(str, [rows[0], rows[2], rows[4]]))


def test_scratch_tables_need_a_shared_folder_on_a_cluster():
    class Cluster:
        conf = {}

        class sparkContext:
            master = "local-cluster[3,2,3000]"

    with pytest.raises(RuntimeError):
        common.shared_dir(Cluster)
    Cluster.sparkContext.master = "spark://host:7077"
    with pytest.raises(RuntimeError):
        common.shared_dir(Cluster)
    Cluster.conf = {"spark.checkpoint.dir": "s3a://bucket/x/"}
    assert common.shared_dir(Cluster) == "s3a://bucket/x"
