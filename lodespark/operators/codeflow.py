"""Call graphs, type hierarchies and wiring over symbols and what their sources say."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.operators import navigation
from lodespark.session import cut


def resolved_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """file_id, line, name, symbol_id, tier: the symbol that each called name means.

    ``calls``: file_id, line, name; ``symbols``: id, file_id, name (each id once); ``imports``: src, dst (files). T1: the only symbol of that name in the
    file, or else in all files; T2: the only one in the files that it imports; T3: none of these, symbol_id is null. Names
    are counted before they are joined, so a common one is never paired with all its symbols.
    """
    c = calls.where(F.col("name").isNotNull()).select("file_id", "line", "name").distinct()
    s = symbols.where(F.col("name").isNotNull()).select("id", "file_id", "name").distinct()
    here = s.groupBy("file_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("own")).where("n = 1").drop("n")
    alone = s.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("only")).where("n = 1").drop("n")
    x = c.join(here, ["file_id", "name"], "left").join(alone, "name", "left")
    x = cut(x.withColumn("first", F.coalesce("own", "only")))
    open_ = x.where(F.col("first").isNull()).select("file_id", "name").distinct()
    known = imports.where(F.col("src") != F.col("dst")).select(F.col("src").alias("file_id"), F.col("dst").alias("other")).distinct()
    near = open_.join(known, "file_id").join(s.select(F.col("file_id").alias("other"), "name", F.col("id").alias("far")), ["other", "name"])
    near = near.groupBy("file_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("far")).where("n = 1").drop("n")
    tier = F.when(F.col("first").isNotNull(), "T1").when(F.col("far").isNotNull(), "T2").otherwise("T3")
    return x.join(near, ["file_id", "name"], "left").select("file_id", "line", "name", F.coalesce("first", "far").alias("symbol_id"), tier.alias("tier"))


def call_graph(resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """caller (null: the file's own level), callee, file_id, line, tier: calls between symbols; the caller is the innermost symbol around the line. Unresolved calls (T3) are left out."""
    edges = resolved.where(F.col("symbol_id").isNotNull())
    around = navigation.enclosing_symbols(edges.select("file_id", "line"), symbols).select("file_id", "line", F.col("symbol_id").alias("caller"))
    return edges.join(around, ["file_id", "line"], "left").select("caller", F.col("symbol_id").alias("callee"), "file_id", "line", "tier")


def hierarchy(bases: DataFrame, asked: DataFrame, down: bool = True) -> DataFrame:
    """root, cls, depth: all classes that derive from each asked one (repo, cls), or with ``down`` false all that it derives from.

    ``bases``: repo, cls, base. Every class is visited once for each root, so cycles end.
    """
    e = bases.select("repo", F.col("base" if down else "cls").alias("at"), F.col("cls" if down else "base").alias("to")).where(F.col("at") != F.col("to")).distinct()
    e = cut(e)
    front = asked.select("repo", F.col("cls").alias("root"), F.col("cls").alias("at")).distinct()
    seen = cut(front.select("repo", "root", F.col("at").alias("to")).withColumn("depth", F.lit(0)))
    depth = 0
    while True:
        depth += 1
        new = front.join(e, ["repo", "at"]).select("repo", "root", "to").distinct().join(seen, ["repo", "root", "to"], "left_anti").withColumn("depth", F.lit(depth))
        new = cut(new)
        if new.isEmpty():
            break
        seen = cut(seen.unionByName(new))
        front = new.select("repo", "root", F.col("to").alias("at"))
    return seen.where("depth > 0").select("repo", "root", F.col("to").alias("cls"), "depth")


def overrides(derived: DataFrame, methods: DataFrame) -> DataFrame:
    """repo, root, cls, name: methods of a root that a class deriving from it declares again. ``derived``: see :func:`hierarchy`; ``methods``: repo, cls, name."""
    m = methods.select("repo", "cls", "name").distinct()
    return derived.join(m, ["repo", "cls"]).join(m.withColumnRenamed("cls", "root"), ["repo", "root", "name"], "left_semi").select("repo", "root", "cls", "name")


def wiring(triggers: DataFrame, symbols: DataFrame) -> DataFrame:
    """``triggers`` (file_id, kind, trigger, by, line) with handler: the innermost symbol at the line, null outside of all."""
    around = navigation.enclosing_symbols(triggers.select("file_id", "line"), symbols).select("file_id", "line", F.col("symbol_id").alias("handler"))
    return triggers.join(around, ["file_id", "line"], "left")
