"""Near-duplicate code: shingles of five tokens, exact set similarity, MinHash signatures and banding.

Codes with the same shingles are one class. Classes are compared by their rarest shingles only: sets of a Jaccard
similarity of t share one of their |s| - ceil(t |s|) + 1 rarest shingles, so no pair is lost and boilerplate, whose
shingles are common, makes no pairs of its own.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodespark.session import cut

#: Tokens of a shingle, and fewest shingles of a code that is compared.
SHINGLE, LEAST_SHINGLES = 5, 15
#: Modulus of the MinHash family; products of two residues stay within 62 bits.
PRIME = (1 << 31) - 1


def code_tokens(code: Column) -> Column:
    """Lower-case tokens without line comments."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(code, r"(?m)#.*$|//.*$", "")), F.lit(r"[A-Za-z0-9_]+"), F.lit(0))


def shingles(tokens: Column, k: int = SHINGLE) -> Column:
    """Distinct hashes of all runs of ``k`` tokens; none for shorter texts."""
    n = F.size(tokens) - k + 1
    runs = F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.array_join(F.slice(tokens, i, k), " "))))
    return F.array_distinct(F.coalesce(runs, F.array().cast("array<bigint>")))


def classes(codes: DataFrame, k: int = SHINGLE, least: int = LEAST_SHINGLES) -> DataFrame:
    """id, class, sh: the shingles of each code (id, code) with at least ``least`` of them; ``class`` is the smallest id with the same shingles."""
    rows = codes.where(F.col("id").isNotNull() & F.col("code").isNotNull()).groupBy("id").agg(F.max("code").alias("code"))
    rows = rows.select("id", F.array_sort(shingles(code_tokens(F.col("code")), k)).alias("sh")).where(F.size("sh") >= least)
    rows = rows.withColumn("_h", F.struct(F.xxhash64("sh"), F.size("sh")))
    same = rows.groupBy("_h").agg(F.min("id").alias("class"))
    return rows.join(same, "_h").drop("_h")


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """a < b, jaccard, containment: all pairs of sets (id, sh) with a Jaccard similarity of ``threshold``.

    Containment is the share of the smaller set. Sets that share none of their rarest members are never compared.
    """
    tokens = sets.select("id", F.size("sh").alias("n"), F.explode("sh").alias("t"))
    rare = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = tokens.join(rare, "t", "left").select("id", "n", "t", F.coalesce("df", F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "t"))
    prefix = ranked.withColumn("k", place).where(F.col("k") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1).where("df > 1").select("id", "n", "t")
    a, b = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "t"), prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "t")
    sized = (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9) & (F.col("a") < F.col("b"))
    pairs = a.join(b, "t").where(sized).select("a", "b").distinct()
    both = F.size(F.array_intersect("sa", "sb"))
    x = pairs.join(sets.select(F.col("id").alias("a"), F.col("sh").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("sh").alias("sb")), "b")
    x = x.select("a", "b", both.alias("i"), F.size("sa").alias("na"), F.size("sb").alias("nb"))
    jaccard = F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))
    return x.select("a", "b", jaccard.alias("jaccard"), (F.col("i") / F.least("na", "nb")).alias("containment")).where(F.col("jaccard") >= threshold - 1e-12)


def clones(codes: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): similar pairs of class representatives (a, b, jaccard, containment), and the class of every code with its number of links (id, class, copies, links).

    ``links`` counts the other codes that are similar: all copies, and all codes of linked classes.
    """
    rows = cut(classes(codes))
    pairs = cut(similar_sets(rows.where(F.col("id") == F.col("class")), threshold))
    sizes = rows.groupBy("class").agg(F.count(F.lit(1)).alias("copies"))
    both = pairs.select(F.col("a").alias("class"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("class"), F.col("a").alias("other")))
    linked = both.join(sizes.select(F.col("class").alias("other"), "copies"), "other").groupBy("class").agg(F.sum("copies").alias("more"))
    members = rows.select("id", "class").join(sizes, "class").join(linked, "class", "left")
    return pairs, members.select("id", "class", "copies", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("links"))


def clones_of(pairs: DataFrame, members: DataFrame, asked: DataFrame) -> DataFrame:
    """id, other, jaccard, containment: all codes similar to each asked one (id); copies have 1."""
    mine = members.join(asked.select("id").distinct(), "id", "left_semi").select("id", "class")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard", "containment"))
    far = mine.join(both, F.col("class") == F.col("a")).join(members.select(F.col("id").alias("other"), F.col("class").alias("b")), "b").select("id", "other", "jaccard", "containment")
    copies = mine.join(members.select(F.col("id").alias("other"), "class"), "class").where(F.col("id") != F.col("other")).select("id", "other", F.lit(1.0).alias("jaccard"), F.lit(1.0).alias("containment"))
    return far.unionByName(copies)


# -- MinHash
def family(permutations: int = 64, seed: int = 24301) -> tuple[list[int], list[int]]:
    """Coefficients of the hash functions (a x + b) mod PRIME."""
    g = np.random.default_rng(seed)
    return g.integers(1, PRIME, permutations).tolist(), g.integers(0, PRIME, permutations).tolist()


def signature(sh: Column, permutations: int = 64, seed: int = 24301) -> Column:
    """MinHash signature of a set of 64-bit hashes; null for the empty set."""
    a, b = family(permutations, seed)
    x = F.transform(sh, lambda h: F.pmod(h, F.lit(PRIME)))
    coefficients = F.array(*[F.struct(F.lit(p).alias("a"), F.lit(q).alias("b")) for p, q in zip(a, b)])
    return F.when(F.size(sh) > 0, F.transform(coefficients, lambda c: F.array_min(F.transform(x, lambda h: (c["a"] * h + c["b"]) % PRIME))))


def banding(threshold: float, permutations: int = 64, recall: float = 0.98) -> tuple[int, int]:
    """(bands, rows): the banding with the fewest false candidates at half the threshold among those that find ``recall`` of the pairs at it; else the one that finds most."""
    s = min(0.999, max(0.01, threshold))
    found = lambda p, rows: 1 - (1 - p**rows) ** (permutations // rows)
    every = range(1, permutations + 1)
    good = [r for r in every if found(s, r) >= recall]
    rows = min(good, key=lambda r: found(s / 2, r)) if good else max(every, key=lambda r: found(s, r))
    return permutations // rows, rows


def banded_candidates(sets: DataFrame, threshold: float, permutations: int = 64) -> DataFrame:
    """a < b: pairs of sets (id, sh; one for each class) that share a band of their signatures."""
    bands, rows = banding(threshold, permutations)
    s = sets.select("id", signature(F.col("sh"), permutations).alias("sig"))
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.xxhash64(F.slice("sig", i * rows + 1, rows)).alias("key")) for i in range(bands)])
    posted = s.select("id", F.explode(keys).alias("k")).select("id", "k.band", "k.key")
    # keys of one set alone are dropped before the join
    often = posted.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "key")
    posted = cut(posted.join(often, ["band", "key"], "left_semi"))
    other = posted.select(F.col("id").alias("b"), "band", "key")
    return posted.withColumnRenamed("id", "a").join(other, ["band", "key"]).where(F.col("a") < F.col("b")).select("a", "b").distinct()


def similarity(a: Column, b: Column) -> tuple[Column, Column]:
    """Jaccard similarity and containment in the smaller of two sets; 0 if one is empty."""
    i, least = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))
    none = least <= 0
    return F.when(none, 0.0).otherwise(i / (F.size(a) + F.size(b) - i)), F.when(none, 0.0).otherwise(i / F.greatest(least, F.lit(1)))


