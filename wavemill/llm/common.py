"""Helpers the pipeline operators share: scratch tables, small-side checks, Arrow plumbing."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows below which a side of a few plain columns (at most 64 bytes a row) is broadcast: 16 MB at most.
BROADCAST_ROWS = 250_000

#: Texts are handed to Python workers in batches of so many rows.
BATCH_ROWS = 512

_own_dir: str | None = None
_tables: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a folder of our own where that is unset and Spark runs in
    this machine's one process (tests). On a cluster an unset one is an error."""
    global _own_dir
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="wavemill-")
    return _own_dir


def written(df: DataFrame, tag: str) -> str:
    """The path of a table in the shared folder that df is written to."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wavemill-{uuid.uuid4().hex}-{tag}"
    _tables.append((spark, path))
    df.write.parquet(path)
    return path


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, tag))


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Have a table in the shared folder deleted like those of keep()."""
    _tables.append((spark, path))


def forget_table_at_exit(spark: SparkSession, name: str) -> None:
    """Have a table of the catalog, in the shared warehouse, dropped like those of keep()."""
    _tables.append((spark, f"table:/{name}"))


def _delete(spark: SparkSession, path: str) -> None:
    if path.startswith("table:/"):
        spark.sql(f"DROP TABLE IF EXISTS {path.removeprefix('table:/')}")
        return
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def tables() -> list[tuple[SparkSession, str]]:
    """What keep() has written so far and nobody has deleted."""
    return list(_tables)


def delete(unused: list[tuple[SparkSession, str]], reading: DataFrame) -> None:
    """Delete those of tables() that `reading` doesn't read."""
    files = reading.inputFiles()
    for entry in unused:
        name = entry[1].rsplit("/", 1)[1]
        if entry in _tables and not any(f"/{name}/" in f for f in files):
            _tables.remove(entry)
            _delete(*entry)


def _at_exit() -> None:
    for spark, path in _tables:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
            elif (local := path.removeprefix("file://")).startswith("/"):  # Spark has been stopped already
                shutil.rmtree(local, ignore_errors=True)
        except Exception:  # noqa: BLE001  the JVM may be gone
            continue


atexit.register(_at_exit)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint where its counted rows are under BROADCAST_ROWS, else as it is (a shuffle join)."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def with_classes(rows: DataFrame, classes: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows joined with their one row of classes(keys, m, ...), m being the rows of a class and total those of all.

    Classes of more rows than a task's even share, of which there are at most as many as partitions, are broadcast: their
    rows stay where they are and don't meet in one task.
    """
    parts = partitions(rows.sparkSession)
    hot, rest = (classes.filter(c).drop("m") for c in (F.col("m") * parts > total, F.col("m") * parts <= total))
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot), keys, "left_anti").join(rest, keys))


def guarded(df: DataFrame, *names: str) -> DataFrame:
    """df with the first column of each of `names` as it is and all others named by place, so that nothing clashes."""
    columns = df.columns
    return df.toDF(*(c if c in names and c not in columns[:k] else f"__{k}" for k, c in enumerate(columns)))


def only(df: DataFrame, **types: str) -> DataFrame:
    """The named columns of df, cast, whatever else df holds (columns that differ in case, or a name twice)."""
    return guarded(df, *types).select(*(F.col(c).cast(t).alias(c) for c, t in types.items()))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blobs(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b or b"" for b in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of large values, one at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


_held: dict[object, object] = {}


def held(key: object, make: Callable[[], object]) -> object:
    """What a worker process keeps from task to task under a key; only tasks that hold it leave it there."""
    if key not in _held:
        _held[key] = make()
    return _held[key]


def _let_go(holds: str | None) -> None:
    for key in [k for k in _held if k[0] != holds]:
        del _held[key]


def over_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str, holds: str | None = None) -> DataFrame:
    """fn over slices of BATCH_ROWS rows, so that long texts don't pile up in a worker."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                out = fn(batch.slice(at, BATCH_ROWS))
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return in_python(df, run, schema, holds)


def trim() -> None:
    """Give what this process has freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        return


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that workers can import what they are to run."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="wavemill-")) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        sc.addPyFile(str(archive))
        _shipped.add(sc.applicationId)


def in_python(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, holds: str | None = None) -> DataFrame:
    """df.mapInArrow(fn, schema) with the package at hand on the executors.

    holds: what of held() the tasks use; a worker that comes to them from other work lets go of all else.
    """
    ship(df.sparkSession)

    def run(batches):
        _let_go(holds)
        yield from fn(batches)
        trim()

    return df.mapInArrow(run, schema)


def record(schema: dict[str, pa.DataType], *columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, schema.values(), strict=True)], names=list(schema))
