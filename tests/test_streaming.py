from wavemill.streaming import levels


def _drain(query):
    query.processAllAvailable()
    query.stop()


def test_windowed_level(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", "value").repartition(2).write.parquet(str(tmp_path / "in"))
    schema = "event_id long, ts timestamp, user_id long, value double"
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    _drain(levels.windowed_db(stream, "ts", "value", "1 hour").writeStream.format("memory").queryName("db").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).start())
    assert spark.table("db").agg({"n": "sum"}).first()[0] == 1000


def test_capped_level_and_chunks(spark, tmp_path):
    rows = [(s, k, (k * 37 + s * 11) % 90 - 40) for s in range(3) for k in range(50)]
    spark.createDataFrame(rows, "s long, k long, d long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("s long, k long, d long").parquet(str(tmp_path / "in"))
    _drain(levels.capped_level(stream, "s", "k", "d", 100).writeStream.format("memory").queryName("level").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start())
    got = {(r["s"], r["k"]): r["level"] for r in spark.table("level").collect()}
    for s in range(3):
        level = 0
        for _, k, d in (x for x in rows if x[0] == s):
            level = min(100, level + d)
            assert got[s, k] == level
    stream = spark.readStream.schema("s long, k long, d long").parquet(str(tmp_path / "in"))
    _drain(levels.overlapped(stream, "k", chunk=16, overlap=4).writeStream.format("memory").queryName("chunks").outputMode("append").option("checkpointLocation", str(tmp_path / "c3")).start())
    assert spark.table("chunks").count() > 150
