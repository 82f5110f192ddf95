from pyspark.sql import DataFrame, SparkSession

from loomspark.operators.spread import parts, spread

#: Line items in one task.
EACH = 200_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_order(spark: SparkSession, sf_dir: str, name: str = "lineitem") -> DataFrame:
    """Line items or orders, an order's rows in one part, in as many parts as there are line items for."""
    return spread(read(spark, sf_dir, name), ["l_orderkey" if name == "lineitem" else "o_orderkey"], parts(read(spark, sf_dir, "lineitem"), EACH))
