import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"

LONG = "word " * 30000 + "x" * 200000

EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Alpha beta gamma delta epsilon zeta eta theta iota kappa"), (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
    (7, LONG), (7, LONG), (8, LONG + " end"), (9, "Ünïcode ‘quotes’ 日本語 ½ ×÷   it's we'll  two  blanks\r\n\tand <|endoftext|> \x1c"), (None, "no id at all"), (None, None),
    (10, "same line here with eight words or more\nsame line here with nine words or more\n\nshort"), (11, "same line here with eight words or more\nshort"), (-12, "mail a.b@c.org, 10.0.0.1 and 10.0.0.999"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, repeats, and columns whose names clash with all sorts of things."""
    rows = [(i, t, "de", i, 0.5, "k", 1, t) for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, node long, score double, key string, n_lines int, size string").repartition(3).toDF("doc_id", "text", "lang", "node", "score", "key", "n_lines", "Text")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def small_rows(small):
    return [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()]
