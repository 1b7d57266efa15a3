"""One ranking from several differently scaled scores: outranking net flow on percentiles.

Every score is replaced by its mid-rank percentile among all targets of the request, so only its order
counts. A linear preference function on the percentile difference d, min(1, d / threshold), compares each
pair of targets on each score; the positive minus the negative flow of a target is its net preference
over all others, averaged over the scores. No pair is ever formed: the sums over all lower and all
higher targets follow from prefix sums over the sorted levels, which are computed across partitions, so
a request with a third of all rows is sorted by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodespark.operators.prefix import running
from lodespark.operators.skew import heavy_keys, skew_join
from lodespark.session import cut

#: Parts of a heavy request's targets in the join with its score levels.
SALTS = 32


def net_flow(
    scores: DataFrame,
    request: str = "request_id",
    target: str = "target",
    channel: str = "channel",
    score: str = "score",
    threshold: float = 0.5,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """Net outranking flow of every target: ``request``, ``target``, ``flow`` in [-1, 1], ``n_scores``.

    Higher scores are better. Null, NaN and infinite scores and rows with a null request, target or channel count as absent;
    absent targets stand below all present ones of a channel and tie with each other. Several scores of
    one target in one channel count as their maximum. Ties share their mid-rank. ``weights`` by channel,
    1 if not named. A target without any usable score has no row; empty input gives none.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    s = F.col(score).cast("double")
    # NaN sorts above all numbers in Spark, so it must go before the maximum; infinities carry no order among themselves
    usable = scores.where(s.isNotNull() & ~F.isnan(s) & (F.abs(s) < F.lit(float("inf"))) & F.col(request).isNotNull() & F.col(target).isNotNull() & F.col(channel).isNotNull())
    best = cut(
        usable.groupBy(F.col(request).alias("r"), F.col(target).alias("t"), F.col(channel).alias("c")).agg(F.max(s).alias("s"))
    )
    # what is known of a request is one row; requests with most of the rows meet it by broadcast, see skew_join
    heavy = heavy_keys(best, "r")
    known = best.select("r", "t").distinct().groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    sizes = best.groupBy("r", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("r").agg(F.map_from_entries(F.collect_list(F.struct("c", "m"))).alias("m"))
    per = cut(known.join(sizes, "r"))
    # distinct score levels; the absent targets are one more level below all others
    levels = best.groupBy("r", "c", "s").agg(F.count(F.lit(1)).alias("k"))
    ranked = skew_join(running(levels, ["r", "c"], ["s"], {"upto": ("sum", "k")}), per, "r", heavy=heavy).select(
        "r", "c", "s", "k", "n",
        (2 * (F.col("n") - F.col("m")[F.col("c")] + F.col("upto")) - F.col("k")).alias("x"),  # 2n times the mid-rank percentile
    )
    absent = per.select("r", "n", F.explode("m").alias("c", "m")).where("n > m").select("r", "c", F.lit(None).cast("double").alias("s"), (F.col("n") - F.col("m")).alias("k"), "n", (F.col("n") - F.col("m")).alias("x"))
    ranked = cut(ranked.unionByName(absent))
    # sums are needed at x, x - T and x + T: probes are put between the levels and read the sums at their place
    span = F.greatest(F.lit(1), F.round(F.lit(2 * threshold) * F.col("n"))).cast("bigint")
    kx = (F.col("k") * F.col("x")).cast("bigint")
    events = ranked.select(
        "r", "c", "s", "x", "n", "k", kx.alias("kx"),
        F.explode(F.array(
            F.struct(F.col("x").alias("at"), F.lit(0).alias("what")),
            F.struct((F.col("x") - span).alias("at"), F.lit(1).alias("what")),
            F.struct((F.col("x") + span).alias("at"), F.lit(2).alias("what")),
        )).alias("e"),
    ).select(
        "r", "c", "s", "x", "n", F.col("e.at").alias("at"), F.col("e.what").alias("what"),
        F.when(F.col("e.what") == 0, F.col("k")).otherwise(0).alias("k"),
        F.when(F.col("e.what") == 0, F.col("kx")).otherwise(0).alias("kx"),
    )
    summed = running(events, ["r", "c"], ["at", "what"], {"ck": ("sum", "k"), "cx": ("sum", "kx")})
    got = summed.groupBy("r", "c", "s", "x", "n").agg(
        *[F.max(F.when(F.col("what") == w, F.col(v))).alias(f"{v}{w}") for w in (0, 1, 2) for v in ("ck", "cx")]
    )
    # a probe at x - T or x + T counts the levels at its own place, whose preference is 1 either way
    T = span.cast("double")
    x = F.col("x")
    plus = F.col("ck1") + ((F.col("ck0") - F.col("ck1")) * x - (F.col("cx0") - F.col("cx1"))) / T
    minus = (F.col("n") - F.col("ck2")) + ((F.col("cx2") - F.col("cx0")) - (F.col("ck2") - F.col("ck0")) * x) / T
    w = F.lit(1.0)
    for name, value in (weights or {}).items():
        w = F.when(F.col("c") == name, F.lit(float(value))).otherwise(w)
    flow = cut(got.select("r", "c", "s", w.alias("w"), ((plus - minus) / F.greatest(F.lit(1), F.col("n") - 1)).alias("phi")))
    none = F.col("s").isNull()
    base = flow.groupBy("r", "c").agg(F.max("w").alias("w"), F.max(F.when(none, F.col("phi"))).alias("phi0")).groupBy("r").agg(
        F.sum("w").alias("total"),
        F.sum(F.coalesce(F.col("w") * F.col("phi0"), F.lit(0.0))).alias("absent"),
        F.map_from_entries(F.collect_list(F.struct("c", F.coalesce("phi0", F.lit(0.0)).alias("phi0")))).alias("phi0"),
    )
    base = cut(base)
    gain = skew_join(flow.where(~none), base.select("r", "phi0"), "r", heavy=heavy).select("r", "c", "s", (F.col("w") * (F.col("phi") - F.col("phi0")[F.col("c")])).alias("gain"))
    # many targets may tie in a heavy request: there both sides are salted
    hot = F.col("r").isin(heavy) if heavy else F.lit(False)
    gain = gain.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    salted = best.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("t"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    per_target = salted.join(gain, ["r", "c", "s", "salt"]).groupBy("r", "t").agg(F.sum("gain").alias("gain"), F.count(F.lit(1)).alias("n_scores"))
    return skew_join(per_target, base.select("r", "total", "absent"), "r", heavy=heavy).select(
        F.col("r").alias(request), F.col("t").alias(target), ((F.col("gain") + F.col("absent")) / F.col("total")).alias("flow"), "n_scores"
    )


def channel_of(reason, channel):
    """The channel a reason names: its leading word, without a trailing -symbol; else the given channel."""
    word = F.regexp_replace(F.regexp_extract(F.lower(F.trim(reason)), r"^([a-z]+(?:-[a-z]+)*)", 1), "-symbol$", "")
    return F.when(F.length(word) > 0, word).otherwise(F.lower(F.trim(channel)))


def top_targets(flows: DataFrame, request: str, target: str, k: int) -> DataFrame:
    """The first ``k`` of every request by flow, then by target. Spark prunes each task to k rows a request first."""
    w = Window.partitionBy(request).orderBy(F.col("flow").desc(), F.col(target))
    return flows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
