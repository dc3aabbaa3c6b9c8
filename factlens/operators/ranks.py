"""Orders without one task: ranks by ranges, and the first rows of many groups at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from factlens.sources.sinks import work_folder

#: Hex digits of a digest that make its bucket: 4096 buckets a group.
DIGITS = 3


def total_rank(df: DataFrame, order: list[str], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """`df` with `name`: the row's place, from 0, in the order of the columns of `order`; "-c" orders by c descending.

    Rows are dealt to ranges of the order (bounds from Spark's sample), written, ranked within their range, and moved up by the rows of
    all ranges before. So no task has more than a range, and all that tasks share is one offset a range. The ranges are written
    because another sample would give other ranges. Nulls come first, or last where descending. Which of equal rows is first is open. Rows
    of equal keys lie in one range, so an order in which very many rows are equal needs a further column. An empty table stays empty.
    """
    spark = df.sparkSession
    sort = [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in order]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{work_folder(spark)}/ranges"
    df.repartitionByRange(n, *sort).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.schema(T.StructType([*df.schema, T.StructField("_range", T.IntegerType())])).parquet(path)
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    # One row a range, however many rows there are.
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*sort)) - 1
    return rows.join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + local).cast("long")).drop("_range", "_before")


def write_sorted(df: DataFrame, path: str, order: list[str], partitions: int | None = None) -> None:
    """A table whose files, by name, and rows within them lie in the order of `order` ("-c": descending): ranges, each sorted by its task."""
    sort = [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in order]
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *sort).sortWithinPartitions(*sort).write.mode("errorifexists").parquet(path)


def first_of_groups(rows: DataFrame, groups: list[str], digest: str, tie: str, wanted: str, name: str = "target_rank", digits: int = DIGITS) -> DataFrame:
    """Of every group the first rows by digest (hexadecimal), then `tie`: as many as its column `wanted` says, with `name` from 0.

    A histogram of the digests' first digits, one for every group, gives the bucket in which a group is filled and the rank at which
    each bucket begins. Only rows of buckets that are needed are shuffled, and they are ranked bucket by bucket: a group is never
    in one task, and the number of jobs does not grow with the groups. Groups are few, as cases or mechanisms are: their needed buckets, at
    most 16 ** digits a group, are broadcast, or all rows would be shuffled to meet them. A null or zero `wanted` takes none.
    """
    placed = rows.withColumn("_bucket", F.substring(digest, 1, digits))
    key = [*groups, "_bucket"]
    counts = placed.groupBy(*key).agg(F.count("*").alias("_n"), F.max(wanted).alias("_wanted"))
    starts = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*groups).orderBy("_bucket")) - F.col("_n"))
    needed = starts.filter(F.col("_before") < F.col("_wanted")).select(*key, "_before")
    local = F.row_number().over(Window.partitionBy(*key).orderBy(digest, tie)) - 1
    ranked = placed.join(F.broadcast(needed), key).withColumn(name, (F.col("_before") + local).cast("long"))
    return ranked.filter(F.col(name) < F.col(wanted)).drop("_bucket", "_before")
