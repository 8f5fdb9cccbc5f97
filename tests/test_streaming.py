from pyspark.sql import functions as F

from padlake.functions.noise import Keyed, ShiftedGeometric
from padlake.operators.partition import uniform_bucket
from padlake.streaming import frequencies

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(EVENTS)
    for k in range(3):
        batch.where(F.col("event_id") % 3 == k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(batch.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def run(df, name):
        q = df.writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return spark.sql(f"SELECT * FROM {name}")

    key = F.col("user_id") + 1
    make = lambda df: frequencies.windowed_key_freq(df, key, "ts", "1 day", "4000 days", 1000)
    last = run(make(stream), "freqs").groupBy("start", "key").agg(F.max("freq").alias("freq"))
    want = make(batch)
    assert last.exceptAll(want).count() == want.exceptAll(last).count() == 0

    pad = ShiftedGeometric(1.0, 1e-3)
    buckets = lambda df: frequencies.windowed_buckets(df, uniform_bucket(key, 1000, 4), "ts", "7 days", "4000 days", pad, Keyed(), "e")
    last = run(buckets(stream), "padded").groupBy("start", "part_id").agg(F.max("n_real").alias("n_real"), F.max("n_dummy").alias("n_dummy"), F.min("n_dummy").alias("low"))
    assert last.where("n_dummy != low").count() == 0
    want = buckets(batch)
    assert last.drop("low").exceptAll(want).count() == 0 and want.agg(F.sum("n_real")).first()[0] == batch.count()
