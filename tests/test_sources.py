"""Writers that are safe to repeat, ingestion, and the shared scratch folder."""

import pytest
from pyspark.sql import functions as F

from tabloom import session as S
from tabloom.sources import readers as I
from tabloom.sources import sinks as O
from tabloom.streaming import ingest as G
from tabloom.streaming.ingest import ingest


def test_reload_may_read_its_own_table(spark):
    path = S.scratch_path(spark, "t")
    assert O.current_version(spark, path) == 0
    assert O.reload(spark.range(5), path) == 1
    assert O.reload(O.read_current(spark, path).where("id > 2"), path) == 2
    assert O.read_current(spark, path).count() == 2


def test_uncommitted_version_is_ignored(spark):
    path = S.scratch_path(spark, "t")
    O.reload(spark.range(5), path)
    spark.range(99).write.parquet(f"{path}/data/version=2")  # a job that died before its ledger row
    assert O.read_current(spark, path).count() == 5
    O.reload(spark.range(7), path)
    assert O.read_current(spark, path).count() == 7


def _ids(spark, lo, hi, plus=0):
    return spark.range(lo, hi).selectExpr("id", f"id + {plus} as v")


def test_ingest_takes_each_file_once(spark):
    inc, target, check = [S.scratch_path(spark, x) for x in ("i", "t", "c")]
    schema = _ids(spark, 0, 1).schema
    args = (spark, inc, target, check, schema, ["id"], ["v"])
    _ids(spark, 0, 10).write.parquet(inc)
    assert ingest(*args).count() == 10
    assert ingest(*args).count() == 10
    _ids(spark, 5, 15, 100).write.mode("append").parquet(inc)
    got = {r.id: r.v for r in ingest(*args).collect()}
    assert got == {i: i if i < 10 else i + 100 for i in range(15)}


def test_a_broken_batch_is_not_seen_and_can_be_sent_again(spark):
    target, schema = S.scratch_path(spark, "t"), _ids(spark, 0, 1).schema
    assert G.read_target(spark, target, schema).count() == 0
    G.append_batch(_ids(spark, 0, 10), 0, target, ["id"], ["v"])
    _ids(spark, 0, 99).withColumn("__bucket", F.lit(0)).write.partitionBy("__bucket").parquet(f"{target}/rows/__batch=1")  # died before its commit
    assert G.read_target(spark, target, schema).count() == 10
    for _ in range(2):  # sent again, and once more after its commit
        G.append_batch(_ids(spark, 8, 13, 100), 1, target, ["id"], ["v"])
        assert sorted(r.id for r in G.read_target(spark, target, schema).collect()) == list(range(13))


def test_a_batch_reads_only_its_keys_of_the_history(spark):
    """Null keys and repeats count once; the filter on buckets and key range reaches the scan."""
    target, schema = S.scratch_path(spark, "t"), _ids(spark, 0, 1).schema
    rows = _ids(spark, 0, 50).unionAll(spark.sql("select cast(null as long) as id, 1L as v from range(3)"))
    G.append_batch(rows, 0, target, ["id"], ["v"])
    G.append_batch(rows.unionAll(_ids(spark, 50, 52)), 1, target, ["id"], ["v"])
    assert G.read_target(spark, target, schema).count() == 53
    assert G.read_target(spark, target, schema).where("__batch = 1").count() == 2
    held = G.read_target(spark, target, schema).where(F.col("__bucket").isin(3) & F.col("id").between(5, 6))
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "GreaterThanOrEqual(id,5)" in plan.replace(" ", "")


def test_jdbc_split_options():
    plain = I.jdbc_options("jdbc:x", "select 1")
    assert plain["query"] == "select 1" and "dbtable" not in plain
    split = I.jdbc_options("jdbc:x", "select * from t", "id", 0, 100, 8)
    assert split["dbtable"] == "(select * from t) q" and split["numPartitions"] == "8" and "query" not in split


def test_missing_newest_file_is_empty(spark):
    files = spark.createDataFrame([("/a/~$x.csv", 1)], "path string, modificationTime int")
    assert I.newest_file(files, ".csv").count() == 0


def test_stable_frames_are_checkpointed(spark):
    df = S.stable(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.count() == 10
    assert spark.sparkContext.getCheckpointDir()


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError):
        S.checkpoint_base(Session())
