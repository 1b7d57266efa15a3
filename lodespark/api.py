"""Six tools over one index: find, read, related, rank, recall, remember. Each takes relations or plain values and gives a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.functions import embedding, text
from lodespark.operators import boosts, channels, clones, codeflow, graph, mining, navigation, notes, search, similarity, snippets


@dataclass
class Workspace:
    """An index and what is known about its use.

    ``files``: id, path, language, vec, days; ``symbols``: id, file_id, kind, name, qualname, line_start, line_end, docstring, vec; ``imports``: id, from_file_id,
    to_file_id, resolution; ``bodies``: file_id, body; ``repositories``: whether the first segment of every path is a repository; ``encode`` turns (DataFrame, id column, text column) into (id, vec). All
    other roles are those of :class:`lodespark.operators.boosts.Index`.
    """

    spark: SparkSession
    files: DataFrame
    symbols: DataFrame
    imports: DataFrame
    bodies: DataFrame
    history: dict[str, DataFrame] = field(default_factory=dict)
    memory: notes.Memory | None = None
    encode: object = embedding.embed
    repositories: bool = False

    # -- find
    def find(self, queries: DataFrame, kind: str = "symbols", k: int = 10) -> DataFrame:
        """query, id, sim, tier, place for searches (query, text): kind symbols, files, or text (BM25 by words: one query only)."""
        q = queries.select(F.col("query").alias("id"), "text")
        if kind == "text":
            terms = sorted({w for r in q.select("text").collect() for w in (r[0] or "").split()})
            body = self.bodies.where(F.col("body").isNotNull()).select(F.col("file_id").alias("id"), text.index_terms(F.col("body")).alias("t"))
            one = F.array_distinct("t")
            counted = body.select("id", F.size("t").alias("len"), F.map_from_arrays(one, F.transform(one, lambda w: F.size("t") - F.size(F.array_remove("t", w)))).alias("tf"))
            return search.bm25(counted, terms).orderBy(F.col("score").desc(), "id").limit(k)
        vec = self.encode(q, "id", F.col("text"))
        rows = self.symbols if kind == "symbols" else self.files
        names = F.array("name", "qualname") if kind == "symbols" else F.array(navigation.file_stem(F.col("path")), text.base_name(F.col("path")), F.col("path"))
        sims = similarity.similarities(rows.select("id", "vec"), "id", "vec", vec)
        return search.search(queries, sims, rows.select("id", names.alias("names")).distinct(), k)

    # -- read
    def read(self, spans: DataFrame) -> DataFrame:
        """id, code of lines of files (id, file_id, line_start, line_end); 0 and null mean from the first and to the last line."""
        whole = spans.withColumn("line_start", F.greatest(F.coalesce("line_start", F.lit(1)), F.lit(1))).withColumn("line_end", F.coalesce(F.nullif("line_end", F.lit(0)), F.lit(2**31 - 1)))
        one = self.bodies.where(F.col("body").isNotNull()).groupBy("file_id").agg(F.max("body").alias("body"))
        return snippets.code_of(whole, one)

    def outline(self, k: int = 8) -> DataFrame:
        return navigation.outline(self.symbols, k)

    # -- related
    def related(self, asked: DataFrame, how: str = "neighbours", **options) -> DataFrame:
        """What is related to files (id): neighbours, tests, ripple, clones (of symbols), or classes (repo, cls) by ``bases`` up or down."""
        edges = self.imports.where(F.col("to_file_id").isNotNull()).select(F.col("from_file_id").alias("src"), F.col("to_file_id").alias("dst"))
        if how == "clones":
            pairs, members = clones.clones(self.read(self.symbols.select("id", "file_id", "line_start", "line_end")), options.get("threshold", 0.8))
            return clones.clones_of(pairs, members, asked)
        if how == "classes":
            return codeflow.hierarchy(options["bases"], asked, options.get("down", True))
        tests = navigation.find_tests(self.files, asked if how == "tests" else self.files, self.imports.select("id", "from_file_id", "to_file_id"), self.repositories)
        if how == "tests":
            return tests
        if how == "ripple":
            empty = edges.limit(0)
            partners = mining.cochange(self.history["baskets"], options.get("now", F.current_timestamp())).select("src", "dst") if "baskets" in self.history else empty
            return graph.ripple(edges, asked.select(F.col("id").alias("node")), tests, partners, options.get("hops", 4))
        if how == "neighbours":
            return search.file_neighbours(asked, self.files, self.imports.select("from_file_id", "to_file_id"), tests, options.get("k", 20))
        raise ValueError(f"unknown relation: {how}")

    # -- rank
    def rank(self, prompts: DataFrame, now: Column | None = None, explain: bool = False, **options) -> DataFrame:
        """The ranking of prompts (request_id, prompt), or every step of it."""
        vec = self.encode(prompts.select("request_id", "prompt"), "request_id", F.col("prompt"))
        p = prompts.select("request_id", "prompt").join(vec, "request_id", "left")
        paths = self.files.select("id", text.plain_path(F.col("path")).alias("path")).distinct()
        i = self.imports.where(F.col("to_file_id").isNotNull())
        by_path = i.join(paths.select(F.col("id").alias("from_file_id"), F.col("path").alias("src")), "from_file_id").join(paths.select(F.col("id").alias("to_file_id"), F.col("path").alias("dst")), "to_file_id").select("src", "dst")
        bodies = self.bodies.join(paths.withColumnRenamed("id", "file_id"), "file_id").select(F.col("path").alias("target"), "body")
        known = {k: v for k, v in self.history.items() if k in ("contexts", "snapshots", "reactive", "events", "intents", "notes")}
        index = boosts.Index(files=self.files, symbols=self.symbols, bodies=bodies, imports=by_path, **known)
        at = now if now is not None else F.current_timestamp()
        return boosts.explain(p, index, at) if explain else boosts.rank(p, index, at, **options)

    # -- recall and remember
    def recall(self, queries: DataFrame, least: float = 0.25, k: int = 5) -> DataFrame:
        """query, topic, sim, place: remembered notes like each search (query, text)."""
        kept = None if self.memory is None else self.memory.notes()
        if kept is None:
            return self.spark.createDataFrame([], "query bigint, topic string, sim double, place int")
        rows = self.encode(kept.select(F.col("topic").alias("id"), F.concat_ws("\n\n", "topic", F.substring("content", 1, 1024)).alias("t")), "id", F.col("t"))
        asked = self.encode(queries.select(F.col("query").alias("id"), "text"), "id", F.col("text"))
        sims = channels.prompt_similarities(asked.withColumnRenamed("id", "request_id"), rows)
        return notes.recalled(sims, least, k).select("query", F.col("id").alias("topic"), "sim", "place")

    def remember(self, rows: DataFrame, version: int) -> bool:
        """Stores notes (topic, content, tags, updated) as one version."""
        if self.memory is None:
            raise ValueError("the workspace has no memory")
        return self.memory.remember(rows, version)
