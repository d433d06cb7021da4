"""Running values that don't need a whole group in one task.

Groups are cut into pieces of an integer column. Windows run over pieces; what a
piece hands on is one row, and a second window runs over those rows, so one huge
group spreads over many tasks. Every call reads its input twice: cut the lineage
before a chain of calls (``session.settled``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions in one piece of a group.
PIECE = 4096


def running(df: DataFrame, group: str, order: str, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, before: bool = False, piece: int = PIECE) -> DataFrame:
    """``df`` with running sums and last non-null values of the group up to the row (``before``: ahead of it)."""
    sums, lasts = sums or {}, lasts or {}
    cut = df.withColumn("_piece", F.floor(F.col(order) / piece))
    for name, value in sums.items():
        cut = cut.withColumn(f"_v_{name}", value.cast("long"))
    for name, value in lasts.items():
        cut = cut.withColumn(f"_v_{name}", value)
    rows = Window.partitionBy(group, "_piece").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    ahead = Window.partitionBy(group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    ends = cut.groupBy(group, "_piece").agg(
        *[F.sum(f"_v_{n}").alias(f"_e_{n}") for n in sums],
        *[F.max(F.when(F.col(f"_v_{n}").isNotNull(), F.struct(F.col(order), f"_v_{n}"))).alias(f"_e_{n}") for n in lasts],
    )
    ends = ends.select(group, "_piece", *[F.sum(f"_e_{n}").over(ahead).alias(f"_a_{n}") for n in sums], *[F.last(f"_e_{n}", ignorenulls=True).over(ahead)[f"_v_{n}"].alias(f"_a_{n}") for n in lasts])
    for name in sums:
        cut = cut.withColumn(f"_o_{name}", F.sum(f"_v_{name}").over(rows))
    for name in lasts:
        cut = cut.withColumn(f"_o_{name}", F.last(f"_v_{name}", ignorenulls=True).over(rows))
    out = cut.join(ends, [group, "_piece"])
    for name in sums:
        out = out.withColumn(name, F.coalesce(f"_o_{name}", F.lit(0)) + F.coalesce(f"_a_{name}", F.lit(0)))
    for name in lasts:
        out = out.withColumn(name, F.coalesce(f"_o_{name}", f"_a_{name}"))
    return out.drop("_piece", *[f"_{k}_{n}" for k in "voa" for n in (*sums, *lasts)])


def carry_last(df: DataFrame, group: str, order: str, value: Column, out: str, before: bool = False) -> DataFrame:
    """``df`` with ``out``, the last non-null ``value`` of the group up to the row (``before``: ahead of it)."""
    return running(df, group, order, lasts={out: value}, before=before)
