"""Search over an index of files and symbols, neighbourhoods, changes, and a kept full-text index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodespark.functions import text
from lodespark.operators import graph, navigation
from lodespark.operators.incremental import VersionedTarget
from lodespark.session import cut


def identifier_of(query: Column) -> Column:
    """The query if it is one bare identifier, else null."""
    q = F.trim(query)
    return F.when(q.rlike(r"^[A-Za-z_][A-Za-z0-9_.]*$"), q)


def literal_tiers(ident: Column, names: Column) -> Column:
    """3 if the identifier is one of the names, 2 if it is the last part of a dotted one, 1 if all its words are in one, else 0; letter case aside."""
    low, words = F.lower(ident), text.search_tokens(ident)
    of = lambda n: (
        F.when(F.lower(n) == low, 3).when(F.endswith(F.lower(n), F.concat(F.lit("."), low)), 2)
        .when((F.size(words) > 0) & (F.size(F.array_except(words, text.search_tokens(n))) == 0), 1).otherwise(0)
    )
    best = F.array_max(F.transform(F.filter(names, lambda n: F.length(n) > 0), of))
    return F.coalesce(F.when(ident.isNotNull(), best), F.lit(0))


def fused(scored: DataFrame, k: int, damping: int = 60) -> DataFrame:
    """query, id, sim, tier, place: exact names first by similarity, then all others by 1 / (damping + place by similarity) plus, for partial names, 1 / (damping + place by tier).

    ``scored``: query, id, sim, tier. Ties in similarity go to the smaller id.
    """
    by = Window.partitionBy("query")
    x = scored.withColumn("i", F.row_number().over(by.orderBy(F.col("sim").desc(), "id")))
    partial = F.col("tier").between(1, 2)
    x = x.withColumn("j", F.when(partial, F.row_number().over(by.orderBy(partial.desc(), F.col("tier").desc(), "i"))))
    rrf = 1.0 / (damping + F.col("i")) + F.coalesce(1.0 / (damping + F.col("j")), F.lit(0.0))
    order = by.orderBy((F.col("tier") == 3).desc(), F.when(F.col("tier") == 3, -F.col("i").cast("double")).otherwise(rrf).desc(), "i")
    return x.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query", "id", "sim", "tier", "place")


def search(queries: DataFrame, sims: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each search. ``queries``: query, text; ``sims``: query, id, sim; ``rows``: id, names (array)."""
    ident = queries.select("query", identifier_of(F.col("text")).alias("ident")).distinct()
    x = sims.join(ident, "query").join(rows.select("id", "names"), "id")
    return fused(x.select("query", "id", "sim", literal_tiers(F.col("ident"), F.col("names")).alias("tier")), k)


def symbol_detail(asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """ask, symbol_id: the symbol of a file with a qualified name, else name, that is asked for; the first by line, then id.

    ``asked``: ask, file_id, name; ``symbols``: id, file_id, name, qualname, line_start. Unknown ones have no row.
    """
    s = symbols.select(F.col("id").alias("symbol_id"), "file_id", "name", "qualname", "line_start")
    place = lambda kind: F.struct(F.lit(kind).alias("kind"), F.col("line_start").isNull().alias("lost"), "line_start", F.col("symbol_id").isNull().alias("none"), "symbol_id").alias("p")
    by = s.select("file_id", F.col("qualname").alias("name"), place(0)).unionByName(s.select("file_id", "name", place(1)))
    # the first of each name before anything is joined: names that come up often in a file make no pairs
    first = by.where(F.col("name").isNotNull()).groupBy("file_id", "name").agg(F.min("p").alias("p"))
    return asked.join(first, ["file_id", "name"]).groupBy("ask").agg(F.min("p").alias("p")).select("ask", "p.symbol_id")


def snippet(files: DataFrame, start: int | None = None, end: int | None = None, most: int | None = None) -> DataFrame:
    """id, snippet: lines ``start`` to ``end`` of each file (id, body), cut behind the last whole line within ``most`` characters. 0 and None mean no bound; either line end counts."""
    lines = F.split("body", r"\r?\n")
    first = max(1, start or 1)
    part = F.slice(lines, first, F.greatest(F.lit(0), F.least(F.size(lines), F.lit(end)) - first + 1) if end else F.greatest(F.lit(0), F.size(lines) - first + 1))
    whole = F.array_join(part, "\n")
    if most:
        whole = F.when(F.length(whole) <= most, whole).otherwise(F.regexp_replace(F.substring(whole, 1, most), r"\n[^\n]*$", ""))
    return files.where(F.col("body").isNotNull()).select("id", whole.alias("snippet"))


def file_neighbours(asked: DataFrame, files: DataFrame, imports: DataFrame, tests: DataFrame, k: int = 20) -> DataFrame:
    """file_id, kind (imports, imported_by, test), other, place: the first ``k`` of each kind, by path or, for tests, by score.

    ``asked``: id; ``files``: id, path; ``imports``: from_file_id, to_file_id; ``tests``: target_id, test_id, score.
    """
    a, paths = asked.select(F.col("id").alias("file_id")).distinct(), files.select(F.col("id").alias("other"), text.plain_path(F.col("path")).alias("path")).distinct()
    out = imports.select(F.col("from_file_id").alias("file_id"), F.col("to_file_id").alias("other"), F.lit("imports").alias("kind"), F.lit(0.0).alias("score"))
    back = imports.select(F.col("to_file_id").alias("file_id"), F.col("from_file_id").alias("other"), F.lit("imported_by").alias("kind"), F.lit(0.0).alias("score"))
    test = tests.select(F.col("target_id").alias("file_id"), F.col("test_id").alias("other"), F.lit("test").alias("kind"), "score")
    rows = out.unionByName(back).unionByName(test).distinct().join(a, "file_id", "left_semi").join(paths, "other")
    w = Window.partitionBy("file_id", "kind").orderBy(F.col("score").desc(), "path", "other")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("file_id", "kind", "other", "place")


def module_graph(edges: DataFrame, root: int, depth: int = 1, most: int = 100) -> tuple[DataFrame, DataFrame, bool]:
    """(nodes, edges, truncated): the import graph around ``root`` within ``depth`` steps in either direction, the ``most`` nearest nodes.

    Nodes at the same distance are taken by their number. Only edges between nodes that are given are given.
    """
    e = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct()
    start = e.sparkSession.createDataFrame([(root,)], "node bigint")
    near = graph.reach(graph.undirected(e.select("src", "dst")), start, depth)
    total = near.count()
    nodes = cut(near.orderBy("hop", "node").limit(max(1, most)))
    inner = e.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
    if depth < 1:
        inner = inner.limit(0)
    return nodes, inner, total > max(1, most)


def changed_context(changed: DataFrame, files: DataFrame, symbols: DataFrame, tests: DataFrame, k: int = 8) -> DataFrame:
    """path, status, symbols, tests: what is known of changed paths (path, status): names of the first symbols and paths of the tests, best first. Paths that are not indexed have empty lists."""
    f = files.select("id", text.plain_path(F.col("path")).alias("path")).distinct()
    c = changed.select(text.plain_path(F.col("path")).alias("path"), "status").distinct().join(f, "path", "left")
    outline = navigation.outline(symbols, k).groupBy(F.col("file_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("symbols"))
    t = tests.join(f.select(F.col("id").alias("test_id"), F.col("path").alias("test")), "test_id").groupBy(F.col("target_id").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "test"))), lambda x: x["test"]).alias("tests")
    )
    none = F.array().cast("array<string>")
    return c.join(outline, "id", "left").join(t, "id", "left").select("path", "status", F.coalesce("symbols", none).alias("symbols"), F.coalesce("tests", none).alias("tests"))


class TextIndex:
    """A kept full-text index: term counts of every text by id, renewed only for texts whose hash is new; ranked by BM25."""

    def __init__(self, spark: SparkSession, path: str):
        self.target = VersionedTarget(spark, path, ["id"], ["hash"])

    def sync(self, files: DataFrame, version: int) -> bool:
        """Takes up new and changed texts (id, hash, body) and marks those that are gone, as one version."""
        now = files.where(F.col("id").isNotNull()).groupBy("id").agg(F.max_by(F.struct("hash", "body"), F.struct("hash", "body")).alias("s")).select("id", "s.*")
        head = self.target.head()
        rows = self.target.changes(now.where(F.col("body").isNotNull()), head) if head else now.where(F.col("body").isNotNull())
        terms = text.index_terms(F.col("body"))
        distinct = F.array_distinct("terms")
        counted = rows.select("id", "hash", terms.alias("terms")).select("id", "hash", F.size("terms").alias("len"), F.map_from_arrays(distinct, F.transform(distinct, lambda t: F.size("terms") - F.size(F.array_remove("terms", t)))).alias("tf"), F.lit(False).alias("gone"))
        state = self.target.state()
        if state is not None:
            gone = state.where("not gone").drop("_version").join(now.where(F.col("body").isNotNull()).select("id"), "id", "left_anti")
            counted = counted.unionByName(gone.select("id", F.lit(None).cast(gone.schema["hash"].dataType).alias("hash"), F.lit(0).alias("len"), F.create_map().cast("map<string,int>").alias("tf"), F.lit(True).alias("gone")))
        if self.target.published(version):
            return False
        return self.target.publish(self.target.stage(counted, version), version, head)

    def terms(self) -> DataFrame:
        """id, len, tf of every text that is there."""
        return self.target.state().where("not gone").select("id", "len", "tf")

    def bm25(self, query: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """id, score of the texts that hold a term of the query; only the kept counts are read."""
        return bm25(self.terms(), query, k1, b)


def bm25(terms: DataFrame, query: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id, score by BM25 from term counts (id, len, tf): idf ln((n - df + 0.5) / (df + 0.5)), at least 1e-6."""
    wanted = sorted({q.lower() for q in query})
    x = terms.select("id", "len", *[F.coalesce(F.try_element_at("tf", F.lit(w)), F.lit(0)).alias(f"tf{i}") for i, w in enumerate(wanted)])
    stats = x.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))])
    score = F.lit(0.0)
    for i in range(len(wanted)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.greatest(F.lit(1e-6), F.ln((F.col("n") - df + 0.5) / (df + 0.5)))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    some = F.lit(False)
    for i in range(len(wanted)):
        some = some | (F.col(f"tf{i}") > 0)
    return x.where(some).crossJoin(F.broadcast(stats)).select("id", score.alias("score"))  # one row


def text_snippet(body: Column, query: Sequence[str], words: int = 12) -> Column:
    """``words`` terms around the first term of the query in a text, that term in brackets; null if there is none."""
    wanted = F.array(*[F.lit(q.lower()) for q in query])
    terms = F.split(F.trim(F.regexp_replace(body, r"\s+", " ")), " ")
    at = F.array_position(F.transform(terms, lambda t: F.arrays_overlap(F.coalesce(text.index_terms(t), F.array().cast("array<string>")), wanted)), True).cast("int")
    first = F.greatest(F.lit(1), at - words // 2)
    around = F.slice(terms, first, words)
    marked = F.transform(around, lambda t, i: F.when(i + first == at, F.concat(F.lit("["), t, F.lit("]"))).otherwise(t))
    return F.when(at > 0, F.array_join(marked, " "))
