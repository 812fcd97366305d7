"""Arrivals in two folders, the second after the first was read."""

from kinweave.sources.tables import RECORD
from kinweave.streaming.ingest import stream_pairs


def test_each_arrival_is_matched_once(spark, tmp_path):
    base = f"file://{tmp_path}"
    anchors = spark.createDataFrame([("S1-1", "Acme Ltd", "1 Road, Pune", "IN"), ("S1-2", "Beta", "x", "IN")], RECORD)
    spark.createDataFrame([("S2-1", "ACME", "1 road pune", "IN"), ("S2-2", "Other", "x", "IN")], RECORD).write.parquet(f"{base}/in")
    arrivals = spark.readStream.schema(RECORD).parquet(f"{base}/in")
    run = lambda: stream_pairs(spark, arrivals, anchors, f"{base}/out", f"{base}/state").awaitTermination(120)
    assert run()
    got = lambda: sorted((r["s1"], r["r"]) for r in spark.read.parquet(f"{base}/out").collect())
    assert got() == [("S1-1", "S2-1")]
    spark.createDataFrame([("S3-1", "beta", "x", "IN")], RECORD).write.mode("append").parquet(f"{base}/in")
    assert run()
    assert got() == [("S1-1", "S2-1"), ("S1-2", "S3-1")]
