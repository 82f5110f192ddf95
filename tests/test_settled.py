"""Tables of rounds in joins: they never pass through the driver, however small their files are."""

from pyspark.sql import functions as F

from loomspark.operators import structure as S
from loomspark.operators.settle import settled


def joins(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_settled_tables_are_not_broadcast(spark):
    # a column of one value takes no room in files; in a hash table each row does
    small = settled(spark.range(1000).select("id", F.lit(1).alias("x")))
    rows = spark.range(5000)
    for side in (small, small.where("x = 1").select("id"), small.groupBy("id").agg(F.max("x"))):
        for plan in (joins(rows.join(side, "id")), joins(side.join(rows, "id")), joins(rows.join(side, "id", "left_anti"))):
            assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_trees_and_ancestors_are_not_broadcast(spark, monkeypatch):
    blocks = spark.createDataFrame([(s, b, b == 0) for s in (1, 2) for b in range(4)], "sample bigint, block bigint, entry boolean")
    edges = spark.createDataFrame([(s, b, b + 1) for s in (1, 2) for b in range(3)], "sample bigint, src bigint, dst bigint")
    for largest in (S.LARGEST, 3):  # one way for all functions, and the other for all
        monkeypatch.setattr(S, "LARGEST", largest)
        tree, _ = S.control_trees(blocks, edges)
        up = S.ancestors(tree)
        for df in (edges.join(up.select("sample", F.col("node").alias("dst")), ["sample", "dst"]), edges.join(tree.select("sample", F.col("node").alias("dst")), ["sample", "dst"])):
            assert "BroadcastHashJoin" not in joins(df) and df.count() >= 6
