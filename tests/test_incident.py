from pyspark.sql import functions as F

from emberlens.operators import logs as L

FAR = 3_000


def _events(spark, seconds):
    rows = [(i, s, "l", "main", "java.lang.OutOfMemoryError") for i, s in enumerate(seconds)]
    d = spark.createDataFrame(rows, "id long, s double, logger string, thread string, exception string")
    return d.withColumn("ts", F.col("s").cast("timestamp")).drop("s")


def _matches(spark, events, captures):
    none = spark.createDataFrame([], "event_id long, class_name string")
    return L.incident_matches(events, none, none.select("class_name"), none.select(F.col("class_name").alias("thread")), captures)


def test_captures_beyond_the_broadcast_align_all_events(spark):
    captures = spark.range(1_200).select((F.col("id") * FAR).cast("timestamp").alias("at"))
    events = _events(spark, [float(k * FAR + 7) for k in range(1_200)] + [1_500.0])
    got = _matches(spark, events, captures).where("aligned").select("id").collect()
    assert sorted(r.id for r in got) == list(range(1_200))


def test_buckets_and_broadcast_agree(spark):
    captures = spark.createDataFrame([(x,) for x in (-450.5, 0.0, 299.5, 900.0, 910.0, 2_000.25)], "s double").select(F.col("s").cast("timestamp").alias("at"))
    events = _events(spark, [x / 4 for x in range(-4_000, 10_000, 3)])
    one, other = (sorted(r.id for r in L.near_captures(events, captures, 300, few).select("id").collect()) for few in (100, 0))
    assert one == other and 0 < len(one) < 4_667
