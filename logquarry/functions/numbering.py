"""Numbers in an order of rows, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.session import settled


def ranked(df: DataFrame, order: list[str], within: str | None = None, name: str = "number") -> DataFrame:
    """``df`` with ``name``: the rows' numbers from 1 in the order of ``order`` (ties in any order), for each value of ``within`` anew.

    Rows are dealt to ranges by a sample of their keys and sorted there; a row's
    number is the sum of the sizes of earlier ranges and its place. Only those sizes, one for each range and value of
    ``within``, are summed on their own; ``within`` has few values, like a category. The sample computes ``df`` once more.
    """
    keys = [*([within] if within else []), *order]
    cut = settled(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    # The upper bits are the range, the lower 33 the place in it.
    part = F.shiftright("_at", 33)
    group = F.col(within) if within else F.lit("")
    sizes = cut.groupBy(group.alias("_group"), part.alias("_part")).agg(F.count("*").alias("_size"), F.min("_at").alias("_least"))
    before = F.expr("sum(_size) OVER (PARTITION BY _group ORDER BY _part) - _size")
    offsets = sizes.select("_group", "_part", "_least", before.alias("_before"))
    joined = cut.withColumn("_group", group).withColumn("_part", part).join(offsets, ["_group", "_part"])
    return joined.withColumn(name, (F.col("_before") + F.col("_at") - F.col("_least") + 1).cast("long")).drop("_group", "_part", "_at", "_least", "_before")
