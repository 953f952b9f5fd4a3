import pytest
from pyspark.sql import functions as F

from emberlens.operators import graph as G
from emberlens.sources import artifacts as A


def test_a_failed_write_leaves_the_artifact_before_it(spark, tmp_path):
    folder = f"file:{tmp_path}/out"
    with pytest.raises(FileNotFoundError):
        A.read_artifact(spark, folder, "flows")
    assert A.write_artifact(spark.range(5), folder, "flows", rule="first") == 1
    bad = spark.range(8, numPartitions=4).withColumn("x", F.when(F.col("id") == 7, F.raise_error(F.lit("killed"))).otherwise(F.lit("")))
    with pytest.raises(Exception, match="killed"):
        A.write_artifact(bad, folder, "flows")
    assert A.read_artifact(spark, folder, "flows").count() == 5
    # killed between the data and its manifest, or with the manifest half written
    spark.range(9).write.parquet(f"{folder}/flows/data-lost")
    (tmp_path / "out/flows/draft-lost").write_text('{"data": "da')
    assert A.read_artifact(spark, folder, "flows").count() == 5 and A.describe_artifact(spark, folder, "flows")["about"] == {"rule": "first"}
    assert A.write_artifact(spark.range(6), folder, "flows") == 2
    assert [A.read_artifact(spark, folder, "flows", v).count() for v in (None, 1, 2)] == [6, 5, 6]
    gone = A.vacuum(spark, folder, "flows")
    assert {"data-lost", "draft-lost", "manifest-0000000001.json"} <= set(gone)
    assert A.read_artifact(spark, folder, "flows").count() == 6 and A.describe_artifact(spark, folder, "flows", 1) is None


def test_versions_are_never_overwritten(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    A.write_artifact(spark.range(1), folder, "a")
    seen, known = [], A._manifests

    def late(store, place):
        """What a writer sees that looked before another one was done."""
        found = known(store, place)
        seen.append(found)
        return [] if len(seen) == 1 else found

    monkeypatch.setattr(A, "_manifests", late)
    assert A.write_artifact(spark.range(2), folder, "a") == 2
    monkeypatch.setattr(A, "_manifests", known)
    assert A.read_artifact(spark, folder, "a", 1).count() == 1 and A.read_artifact(spark, folder, "a").count() == 2
    A.write_artifact(spark.range(3), folder, "b")
    assert A.list_artifacts(spark, folder) == [("a", 2), ("b", 1)]
    assert A.delete_artifact(spark, folder, "a") and not A.delete_artifact(spark, folder, "a")
    assert A.list_artifacts(spark, folder) == [("b", 1)]
    for name in ("", "../b", "a/b", ".hidden"):
        with pytest.raises(ValueError, match="name"):
            A.write_artifact(spark.range(1), folder, name)


def test_searches_say_what_they_left(spark):
    e = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)] + [("n15", "m")], "src string, dst string")
    r = spark.createDataFrame([("n00",), ("n17",)], "node string")
    t = spark.createDataFrame([("n05",), ("n18",), ("n16",), ("m",)], "node string")
    got = {(x.target, x.root, x.hops, x.partial) for x in G.paths_to_roots(e, r, t, depth=6).collect()}
    assert got == {("n05", "n00", 5, False), ("n18", "n17", 1, False), ("n16", None, None, True), ("m", None, None, True)}
    assert all(not x.partial for x in G.paths_to_roots(e, r, t).collect())
    far = {x.node: x.depth for x in G.distances(e, r.where("node = 'n00'")).collect()}
    assert far["n20"] == 20 and far["m"] == 16
    assert max(x.depth for x in G.distances(e, r.where("node = 'n00'"), 4).collect()) == 4
