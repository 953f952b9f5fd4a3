from pyspark.sql import functions as F

from emberlens.plans import ingest


def test_pairs_of_all_users_are_aligned(spark, tmp_path):
    e = spark.range(600).select(F.col("id").alias("event_id"), (F.col("id") % 100).alias("user_id"), F.timestamp_seconds("id").alias("ts"), F.concat(F.lit("k"), (F.col("id") % 7).cast("string")).alias("event_type"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    got = ingest.cmp_align(spark, str(tmp_path))
    n = {r.pair: (r.good, r.bad) for r in got.groupBy("pair").agg(F.count("good_seq").alias("good"), F.count("bad_seq").alias("bad")).collect()}
    assert n == {str(k): (6, 6) for k in range(50)}
