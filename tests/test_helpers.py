from ledgermatch.operators.once import evaluate_once
from ledgermatch.session import checkpoint_dir, shared_root
from ledgermatch.sources.tables import read_table
from pyspark.sql import functions as F


def test_read_table_partitions(spark):
    path = "/root/testdata/sf0.001/nation.parquet"
    assert read_table(spark, path, 3).rdd.getNumPartitions() == 3
    assert read_table(spark, path).count() == read_table(spark, path, 3).count()


def test_evaluate_once(spark):
    df = evaluate_once(spark.range(3), {"x": F.col("id") * 2}).where("x > 0")
    assert sorted(r.x for r in df.collect()) == [2, 4]


def test_checkpoint_dir_is_kept(spark):
    assert checkpoint_dir(spark) == checkpoint_dir(spark)
    assert shared_root(spark) is None or shared_root(spark) in checkpoint_dir(spark)
