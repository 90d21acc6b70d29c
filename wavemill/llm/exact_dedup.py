"""Exact dedup by distributed most-significant-digit radix partitioning over the bytes of the texts."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.llm import common

#: Bytes of the first radix digit, and of the second; each later one is FACTOR times as wide, so a text of n bytes takes
#: log(n) rounds. The first is narrow, as all rows have it and nearly all rows that have no equal leave there.
FIRST, SECOND, FACTOR = 32, 512, 16

#: Bits of the filter of first digits that more than one row has, at most: 8 MB for each task, however large the input.
FILTER_BITS = 1 << 26

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_ROWS = {"doc_id": pa.int64(), "sha": pa.binary(), "size": pa.int64(), "digit": pa.binary(), "rest": pa.binary()}
_ROWS_SCHEMA = "doc_id long, sha binary, size long, digit binary, rest binary"


def _head(text: Column) -> Column:
    """The first FIRST bytes of a text, lower-cased (as many characters have them)."""
    return F.substring(F.translate(F.substring(text, 1, FIRST), _UPPER, _LOWER).cast("binary"), 1, FIRST)


def _bit(bits: int) -> Column:
    return F.pmod(F.xxhash64("size", "digit"), F.lit(bits))


def _filter(groups: DataFrame, n: int) -> np.ndarray:
    """Words of 64 bits, with a bit for each value of _bit() that one of n groups(size, digit) has."""
    bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * n).bit_length()))
    masks = groups.select(_bit(bits).alias("bit")).groupBy(F.expr("cast(bit div 64 as int)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[masks.column("word").to_numpy()] = masks.column("mask").to_numpy()
    return out


def _repeated(rows: DataFrame) -> DataFrame:
    """Groups of rows(gid, size, digit, doc_id) with more than one row: n, the largest doc_id, and a number, next."""
    groups = rows.groupBy("gid", "size", "digit").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id")).filter("n > 1")
    return common.keep(groups.select("gid", "size", "digit", "n", "keep_id", F.monotonically_increasing_id().alias("next")), "groups")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id long, text string): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Groups are found by comparing bytes: the first digit is a
    text's length with its first bytes, and each round splits every group by its next digit, wider than the one before. A
    row is settled once its group has one row, or once its group's texts have ended. The digest is output only.

    The first digit takes a narrow pass over all rows. Then texts are read once more: rows whose first digit no other row
    has (as a filter of bounded size tells, which lets some others through) are settled there, and the others carry what
    is left of their texts from round to round. Digits are counted before each shuffle; a hot group's rows meet their
    group's one count row in a join that Spark can split.

    Null texts count as empty and equal each other. Of equal texts the largest doc_id stays; a null doc_id stays only
    where the group has no other. Repeated rows count in group_size, and all that carry keep_id are marked kept. An
    empty table gives an empty result; other columns are ignored.
    """
    docs = common.only(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    heads = docs.select("doc_id", F.lit(0).cast("long").alias("gid"), F.octet_length("text").cast("long").alias("size"), _head(F.col("text")).alias("digit"))
    groups = _repeated(heads)
    known = docs.sparkSession.sparkContext.broadcast(_filter(groups, groups.count()))
    bits = 64 * len(known.value)

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [b.lower() for b in common.blobs(batch.column("text"))]  # bytes.lower() changes A-Z only
        bit = batch.column("bit").to_numpy()
        maybe = (known.value[bit >> 6] >> (bit & 63) & 1).tolist()
        return common.record(_ROWS, batch.column("doc_id"), [hashlib.sha256(b).digest() for b in texts], [len(b) for b in texts], [b[:FIRST] if m else None for b, m in zip(texts, maybe, strict=True)], [b[FIRST:] if m else None for b, m in zip(texts, maybe, strict=True)])

    asked = docs.withColumns({"size": F.octet_length("text").cast("long"), "digit": _head(F.col("text"))}).select("doc_id", "text", _bit(bits).alias("bit"))
    rows = common.keep(common.over_texts(asked, split, _ROWS_SCHEMA), "rows")
    no_group = [F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("keep_id")]
    done = [rows.filter("digit is null").select("doc_id", "sha", *no_group)]
    active, width, offset = rows.filter("digit is not null").withColumn("gid", F.lit(0).cast("long")), SECOND, FIRST
    while True:
        met = common.keep(active.join(groups, ["gid", "size", "digit"], "left").select("doc_id", "sha", "size", "rest", "n", "keep_id", "next"), "split")
        done.append(met.filter((F.col("n").isNull()) | (F.col("size") <= offset)).select("doc_id", "sha", "n", "keep_id"))
        going = met.filter((F.col("n").isNotNull()) & (F.col("size") > offset))
        if not going.limit(1).count():
            break
        active = going.select("doc_id", "sha", "size", F.col("next").alias("gid"), F.expr(f"substring(rest, 1, {width})").alias("digit"), F.expr(f"substring(rest, {width + 1})").alias("rest"))
        groups = _repeated(active)
        offset, width = offset + width, width * FACTOR
    out = functools.reduce(DataFrame.unionByName, done)
    keep_id = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep_id.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
