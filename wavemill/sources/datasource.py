"""Audio files as a Spark data source: spark.read.format("wavemill_audio").load(path)."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wavemill.sources import audio


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        root = Path(self.path)
        return [_File(str(p)) for p in ([root] if root.is_file() else sorted(root.rglob("*"))) if p.is_file()]

    def read(self, partition):
        try:
            _, clip = audio._parsed(Path(partition.path).read_bytes())
        except audio.Refused:
            return
        for n, frame in enumerate(clip.samples):
            for ch, s in enumerate(frame.tolist()):
                yield (partition.path, n, ch, None, float(s)) if clip.is_float else (partition.path, n, ch, int(s), None)


class AudioSource(DataSource):
    """Samples of local WAV and AIFF files, a partition each; files that are refused give no rows. For files in other
    stores, read them with audio.read_files() and take audio.samples()."""

    @classmethod
    def name(cls) -> str:
        return "wavemill_audio"

    def schema(self) -> str:
        return audio.SAMPLES

    def reader(self, schema):
        return _Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AudioSource)
