"""Per-key results when a few keys hold most records.

Heavy keys are found with a mergeable frequent-items sketch. Their rows are joined with the (at most
1/share) matching dimension rows by broadcast and aggregated map-side first; all other keys take one
ordinary shuffle on the key. Both parts are united, so no row is dropped, capped or sampled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counters of the sketch: its error is below 3.5 / TRACKED of the rows, far under any sensible share.
TRACKED = 4096


def heavy_keys(df: DataFrame, key: str, share: float = 0.01) -> list:
    """Keys of at least ``share`` of the rows (superset up to the sketch's error); never more than 1/share + 1.

    Null keys are not reported. An empty input gives an empty list.
    """
    if not 0 < share < 1:
        raise ValueError("share must lie between 0 and 1")
    row = (
        df.where(F.col(key).isNotNull())
        .agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(`{key}`, {math.ceil(1 / share) + 1}, {TRACKED})").alias("top"))
        .first()
    )
    if row is None or not row["n"]:
        return []
    floor = max(1.0, row["n"] * (share - 3.5 / TRACKED))
    return [x["item"] for x in row["top"] if x["count"] >= floor]


def _split(df: DataFrame, key: str, heavy: list) -> tuple[DataFrame | None, DataFrame]:
    if not heavy:
        return None, df
    return df.where(F.col(key).isin(heavy)), df.where(F.col(key).isNull() | ~F.col(key).isin(heavy))


def skew_join(
    facts: DataFrame, dim: DataFrame, key: str, how: str = "inner", share: float = 0.01, heavy: list | None = None
) -> DataFrame:
    """Join a skewed ``facts`` with ``dim`` (made unique on ``key``) on ``key``.

    Heavy keys meet at most 1/share + 1 dimension rows, which are broadcast; the rest shuffles.
    ``how``: inner, left, left_semi or left_anti. Null keys never match: they are dropped by inner and
    left_semi and kept by left and left_anti. Repeated rows of ``facts`` stay. Of repeated keys in
    ``dim`` one row is kept. Columns of ``dim`` that clash with ``facts`` are dropped from ``dim``.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join: {how}")
    dim = dim.select(key, *[c for c in dim.columns if c not in facts.columns]).where(F.col(key).isNotNull())
    if how in ("left_semi", "left_anti"):
        dim = dim.select(key)
    if heavy is None:
        heavy = heavy_keys(facts, key, share)
    hot, rest = _split(facts, key, heavy)
    out = rest.join(dim.dropDuplicates([key]), key, how)
    if hot is None:
        return out
    hot_dim = dim.where(F.col(key).isin(heavy)).dropDuplicates([key])
    return out.unionByName(hot.join(F.broadcast(hot_dim), key, how))


def _once(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """One row of each record; the last one by all other columns."""
    rest = [c for c in df.columns if c not in (key, id_col)]
    if not rest:
        return df.dropDuplicates([key, id_col])
    return df.groupBy(key, id_col).agg(F.max(F.struct(*rest)).alias("_s")).select(key, id_col, "_s.*")


def per_key(
    facts: DataFrame,
    key: str,
    id_col: str,
    aggs: Sequence[Column],
    dim: DataFrame | None = None,
    share: float = 0.01,
) -> DataFrame:
    """One row per non-null ``key``: its aggregates over the distinct records, without straggler tasks.

    Records delivered more than once (same ``key`` and ``id_col``) count once; of differing deliveries the
    one that is last by the other columns in their order counts (nulls first). ``aggs`` must be
    algebraic (sum, count, min, max): they are computed map-side before the heavy keys' tiny shuffle.
    With ``dim`` (unique on ``key``; repeats are dropped) only keys found there stay, with its columns.
    Empty input gives no rows; null keys give no row; null ids count as one record of their key.
    """
    facts = facts.where(F.col(key).isNotNull())
    heavy = heavy_keys(facts, key, share)
    hot, rest = _split(facts, key, heavy)
    extra: list[str] = []
    if dim is not None:
        extra = [c for c in dim.columns if c != key and c not in facts.columns]
        dim = dim.select(key, *extra).where(F.col(key).isNotNull())
    # the light keys: one exchange on the key serves the dedupe, the aggregate and the join
    light = _once(rest.repartition(F.col(key)), key, id_col).groupBy(key).agg(*aggs)
    if dim is not None:
        light = light.join(dim.dropDuplicates([key]), key, "inner" if extra else "left_semi")
    if hot is None:
        return light
    # the heavy keys: distinct over (key, id) spreads them, then partial aggregates leave one row per task and key
    part = _once(hot, key, id_col)
    if dim is not None:
        hot_dim = F.broadcast(dim.where(F.col(key).isin(heavy)).dropDuplicates([key]))
        part = part.join(hot_dim, key, "inner" if extra else "left_semi")
    hot_out = part.groupBy(key, *extra).agg(*aggs)
    return light.unionByName(hot_out)


def dominant_keys(facts: DataFrame, key: str, id_col: str, dim: DataFrame, least: float, of_dim_only: bool) -> DataFrame:
    """Keys of ``dim`` that hold at least ``least`` of the distinct ids: columns ``key``, ``n``.

    The base is all distinct ids of ``facts``, or with ``of_dim_only`` those whose key is in ``dim``.
    """
    from lodespark.session import cut

    facts = facts.select(key, id_col)
    known = dim.select(key).withColumn("known", F.lit(True))
    if of_dim_only:
        counts = cut(per_key(facts, key, id_col, [F.count(F.lit(1)).alias("n")], dim.select(key), share=least / 2.5))
        total = counts.agg(F.sum("n")).first()[0]
        return counts.where(F.col("n") >= F.lit(least * (total or 0))).where(F.col("n") > 0)
    counts = cut(per_key(facts, key, id_col, [F.count(F.lit(1)).alias("n")], share=least / 2.5))
    loose = facts.where(F.col(key).isNull()).select(id_col).distinct().count()
    total = (counts.agg(F.sum("n")).first()[0] or 0) + loose
    big = counts.where(F.col("n") >= F.lit(least * total))
    # at most 1/least keys are left
    return known.dropDuplicates([key]).join(F.broadcast(big), key).select(key, "n")
