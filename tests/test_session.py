import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from normtrace import session


def stub(folder, master="local[4]"):
    get = lambda key, default=None: folder
    return SimpleNamespace(conf=SimpleNamespace(get=get), sparkContext=SimpleNamespace(
        getConf=lambda: SimpleNamespace(get=get), applicationId="app", master=master))


def test_shared_folder_is_the_clusters_or_a_temporary_one():
    assert session.shared_folder(stub("hdfs://x/y/")) == "hdfs://x/y"
    local = session.shared_folder(stub(None))
    assert local == session.shared_folder(stub(None)) and "spark-" in local


@pytest.mark.parametrize("master", ["spark://x:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"])
def test_cluster_without_a_shared_folder_stops(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(stub(None, master))
    assert session.shared_folder(stub("hdfs://x", master)) == "hdfs://x"


def test_intermediate_tables_go_after_use(spark):
    outside = session.settle(spark.range(5), "outside")
    with session.intermediate_tables(spark):
        inside = session.settle(spark.range(7), "inside")
        path = inside.inputFiles()[0].removeprefix("file:")
        assert inside.count() == 7 and os.path.exists(path)
    assert not os.path.exists(path) and outside.count() == 5


def test_settle_keeps_rows_and_schema(spark):
    df = spark.range(100).withColumn("x", F.array(F.col("id").cast("string")))
    back = session.settle(df, "t")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert [f.dataType.simpleString() for f in back.schema] == [f.dataType.simpleString() for f in df.schema]


def test_spread_only_when_there_are_too_few_partitions(spark):
    assert session.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(10, numPartitions=9)
    assert session.spread(many) is many


def test_once_is_not_repeated_by_a_filter(spark):
    df = session.once(spark.range(10), "v", F.try_parse_json(F.col("id").cast("string")))
    plan = df.where("v IS NOT NULL")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 1
    assert df.count() == 10


def test_settled_table_of_repeated_values_is_no_broadcast(spark):
    names = F.array(*[F.lit(f"state number {i}") for i in range(20)])
    links = session.settle(spark.range(40_000).select((F.col("id") % 20).alias("norm_id"), names.alias("downs")), "links")
    joined = spark.range(1_000_000).withColumnRenamed("id", "norm_id").join(links, "norm_id", "left")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
