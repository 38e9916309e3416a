from pyspark.sql import functions as F

from anisomap.plans.inputs import event_transitions
from anisomap.streaming import transitions as T


def test_stream_counts_are_those_of_the_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    ordered = events.orderBy("ts", "event_id").withColumn("event_id", F.monotonically_increasing_id())
    ordered.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(ordered.schema).parquet(f"file://{tmp_path}/in")
    q = T.transitions(stream).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    steps = spark.read.parquet(f"file://{tmp_path}/out")
    got = {(r.src, r.dst): r.n for r in T.transition_distances(steps.groupBy("src", "dst").agg(F.count("*").alias("n"))).collect()}
    assert got == {(r.src, r.dst): r.n for r in event_transitions(spark, sf).collect()}
    windows = T.windowed_counts(steps)
    assert windows.agg(F.sum("n")).first()[0] == steps.count()
