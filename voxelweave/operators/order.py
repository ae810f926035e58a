"""Numbers and running sums over a total order, without a task that sees all rows: ranges of the order are partitions,
each adds up its own, and a small table of the partitions says where each begins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import written


def numbered(df: DataFrame, by: list[str], number: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """df with the number of each row in the order of `by` (unique keys), from 1, and for each of sums the sum over all rows before it."""
    sums = sums or {}
    cols = {f"_of_{n}": c for n, c in sums.items()}
    # ids of rows in a partition rise in its order; written, so that ranges and ids stay as they are
    ranged = df.withColumns(cols).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    ranged = written(ranged.withColumn("_part", F.shiftright("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id"))
    parts = ranged.groupBy("_part").agg(F.count("*").alias("_rows"), *[F.sum(c).alias(f"_sum{c}") for c in cols])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    zero = F.lit(0)
    parts = parts.select("_part", F.coalesce(F.sum("_rows").over(before), zero).alias("_rows0"), *[F.coalesce(F.sum(f"_sum{c}").over(before), zero).alias(f"_sum0{c}") for c in cols])
    own = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(parts), "_part").withColumn(number, F.col("_rows0") + F.col("_place") + 1)
    for n, c in zip(sums, cols):
        out = out.withColumn(n, F.col(f"_sum0{c}") + F.coalesce(F.sum(c).over(own), zero))
    return out.select(*df.columns, number, *sums)
