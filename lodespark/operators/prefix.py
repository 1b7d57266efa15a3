"""Running aggregates within groups of any size, with no task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodespark.session import cut

_OF = {"sum": F.sum, "min": F.min, "max": F.max}
_JOINED = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}


def running(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """Aggregates of all rows up to and including each row within ``groups`` by ``order``.

    ``aggs``: name of the new column -> (sum, min or max; column). Range partitions are sorted and aggregated
    on their own; what the partitions before come to, at most one row per partition and group, is added
    afterwards. Rows that tie on ``order`` get values in an undefined order. Rows with a null group are dropped.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = cut(df.repartitionByRange(*[F.col(c) for c in groups], *by).withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy("_part", *groups).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*groups, "_part").agg(*[_OF[f](c).alias(f"_{n}") for n, (f, c) in aggs.items()])
    totals = totals.select(*groups, "_part", *[_OF[f](f"_{n}").over(before).alias(f"_{n}") for n, (f, _) in aggs.items()])
    inner = placed.select("*", *[_OF[f](c).over(local).alias(n) for n, (f, c) in aggs.items()])
    return inner.join(totals, [*groups, "_part"]).select(*df.columns, *[_JOINED[f](F.col(n), F.col(f"_{n}")).alias(n) for n, (f, _) in aggs.items()])
