"""Queries of the ranking, search, graph and mining operators, bound to the data folders' tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.functions import text
from lodespark.operators import behaviour, graph, lexical, mining, navigation, ranking, similarity
from lodespark.session import cut, table
from lodespark.sources import tree
from lodespark.streaming import events as streams


def _r(c: str, digits: int = 6):
    return F.round(F.col(c) + 1e-9, digits).alias(c)


# -- mining
def _baskets(s: SparkSession, sf: str) -> DataFrame:
    lines = table(s, sf, "lineitem").select("l_orderkey", "l_partkey")
    return (
        lines.join(table(s, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(s, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("o_custkey").alias("basket"), F.col("p_brand").alias("item"), F.col("o_orderdate").alias("at"))
    )


def _cochange(s: SparkSession, sf: str) -> DataFrame:
    return mining.cochange(_baskets(s, sf), F.lit("1999-01-01 00:00:00").cast("timestamp"))


def cochange_partners(s: SparkSession, sf: str) -> DataFrame:
    return _cochange(s, sf).select("src", "dst", "support", *[_r(c) for c in ("confidence", "confidence_low", "lift", "llr", "strength")])


def cochange_hidden(s: SparkSession, sf: str) -> DataFrame:
    part = table(s, sf, "part").where("p_size = 1").select("p_type", "p_brand").distinct()
    links = part.join(part.withColumnRenamed("p_brand", "dst"), "p_type").select(F.col("p_brand").alias("src"), "dst").where("src < dst")
    return mining.hidden_first(_cochange(s, sf), links, 3).select("src", "dst", "linked", F.col("place").cast("bigint").alias("place"), _r("strength"))


def log_odds_profile(s: SparkSession, sf: str) -> DataFrame:
    docs = table(s, sf, "ci_symbols").select("id", "kind", "docstring").distinct().select(F.lower(F.trim("kind")).alias("kind"), "docstring")
    return mining.distinctive_terms(docs, "kind", F.col("docstring")).select("kind", "term", "n", _r("z", 4), "evidence")


def shared_key_edges(s: SparkSession, sf: str) -> DataFrame:
    i = table(s, sf, "ci_imports").where("resolution = 'internal'").select("from_file_id", "to_file_id")
    return mining.shared_key_edges(i, "from_file_id", "to_file_id").select("src", "dst", "n", _r("weight"))


# -- lexical
def name_postings(s: SparkSession, sf: str) -> DataFrame:
    return lexical.postings(table(s, sf, "part"), "p_partkey", F.concat_ws(" ", "p_type", "p_name"))


def lexical_items(s: SparkSession, sf: str) -> DataFrame:
    index = lexical.postings(table(s, sf, "part"), "p_partkey", F.col("p_name"))
    words = [r[0] for r in index.groupBy("token").count().orderBy(F.desc("count"), "token").limit(3).collect()]
    return lexical.lexical_scores(index, words, 0.6, 0.4, 1.4)


def symbol_scores(s: SparkSession, sf: str) -> DataFrame:
    return lexical.symbol_scores(table(s, sf, "ci_symbols"), ["ledger", "cache", "merge", "method"]).select("id", "n_matched", _r("score", 3))


def grep_literal(s: SparkSession, sf: str) -> DataFrame:
    return lexical.grep(table(s, sf, "fts_files"), "ledger")


def literal_content(s: SparkSession, sf: str) -> DataFrame:
    return lexical.literal_content(table(s, sf, "fts_files"), ["ledger", "merge_", "snapshot"]).select("id", "n_found", _r("score", 3))


def bm25_rank(s: SparkSession, sf: str) -> DataFrame:
    return lexical.bm25(table(s, sf, "fts_files"), ["return", "items", "catch"]).select("id", _r("score"))


# -- vectors
def _asked(s: SparkSession, sf: str) -> DataFrame:
    """The searches: every row whose id is divisible by 20."""
    return table(s, sf, "embeddings").where("vec_id % 20 = 0")


def _sims(s: SparkSession, sf: str) -> DataFrame:
    return similarity.similarities(table(s, sf, "embeddings"), "vec_id", "embedding", _asked(s, sf))


def cosine_topk(s: SparkSession, sf: str) -> DataFrame:
    return similarity.top_similar(table(s, sf, "embeddings"), "vec_id", "embedding", _asked(s, sf), 10).select("query", "id", _r("sim"))


def fuzzy_scores(s: SparkSession, sf: str) -> DataFrame:
    return similarity.fuzzy_scores(_sims(s, sf), threshold=0.1).select("query", "id", _r("score"))


def adaptive_threshold(s: SparkSession, sf: str) -> DataFrame:
    return similarity.adaptive_threshold(_sims(s, sf), 0.45).select("query", _r("threshold"))


def rank_fusion(s: SparkSession, sf: str) -> DataFrame:
    """Two whole lists a query: all rows by similarity, and the rows of its own label by id."""
    from pyspark.sql import Window

    a = _sims(s, sf).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("sim").desc(), "id")))
    labels = table(s, sf, "embeddings").select(F.col("vec_id").alias("id"), "label").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("id")))
    b = labels.join(_asked(s, sf).select(F.col("vec_id").alias("query"), "label").distinct(), "label")
    lists = a.select("query", "id", "rank").unionByName(b.select("query", "id", "rank"))
    return ranking.reciprocal_rank_fusion(lists).select("query", "id", _r("score", 8))


# -- behaviour
def _events(s: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    role = F.when(kind == "view", "read").when(kind == "click", "retrieved").when(kind == "purchase", "edit").when(kind == "signup", "cited").otherwise("dismissed")
    return table(s, sf, "events").select(
        F.col("user_id").alias("session"), F.col("event_id").alias("id"), F.col("ts").alias("at"), role.alias("event_type"), F.get_json_object("props", "$.k").alias("target"), F.lit(1.0).alias("weight")
    )


def _turned(s: SparkSession, sf: str) -> DataFrame:
    return behaviour.turns(_events(s, sf), F.col("event_type") == "cited")


def turn_numbers(s: SparkSession, sf: str) -> DataFrame:
    return _turned(s, sf).select("session", "id", *[F.col(c).cast("bigint").alias(c) for c in ("iteration", "turn", "distance")])


def pattern_classes(s: SparkSession, sf: str) -> DataFrame:
    return behaviour.patterns(_events(s, sf))


def reactive_scores(s: SparkSession, sf: str) -> DataFrame:
    return behaviour.reactive(_turned(s, sf)).select("session", "target", "pattern", _r("score"))


def session_snapshot(s: SparkSession, sf: str) -> DataFrame:
    return behaviour.snapshot(behaviour.reactive(_turned(s, sf))).select("session", "target", "pattern", _r("score"))


def base_rate_discount(s: SparkSession, sf: str) -> DataFrame:
    return behaviour.base_rates(behaviour.reactive(_turned(s, sf))).select("target", "df", "n", _r("discount"))


def cooccurrence_boost(s: SparkSession, sf: str) -> DataFrame:
    snap = behaviour.snapshot(behaviour.reactive(_turned(s, sf)))
    return behaviour.cooccurring(snap, ["3", "17", "42"], 2.0).select("target", "sessions", _r("boost"))


def dismissal_penalty(s: SparkSession, sf: str) -> DataFrame:
    events = _events(s, sf)
    return behaviour.dismissal_penalty(events, events.select("session")).select("target", "dismissals", _r("penalty"))


def last_writer_wins(s: SparkSession, sf: str) -> DataFrame:
    e = table(s, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return behaviour.latest_writes(e, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def retract_failed(s: SparkSession, sf: str) -> DataFrame:
    return behaviour.retract_failed(_events(s, sf), F.col("event_type") == "dismissed").select("session", "target", "id")


def session_windows(s: SparkSession, sf: str) -> DataFrame:
    w = streams.session_windows(_events(s, sf), "21600 seconds")
    return w.select("session", F.unix_timestamp("start").alias("started"), F.unix_timestamp("end").alias("ended"), "n")


# -- ranking
def _ranked(s: SparkSession, sf: str) -> DataFrame:
    return ranking.usable(table(s, sf, "ranked_items").select("request_id", "target", "target_type", "score", "reason", "ord"))


def merge_synergy(s: SparkSession, sf: str) -> DataFrame:
    return ranking.merge(_ranked(s, sf)).select("request_id", "target", _r("score", 4), "n")


def best_channel_row(s: SparkSession, sf: str) -> DataFrame:
    return ranking.best_of(_ranked(s, sf)).select("request_id", "target", "reason", "ord")


def logodds_fusion(s: SparkSession, sf: str) -> DataFrame:
    return ranking.log_odds_fusion(_ranked(s, sf)).select("request_id", "target", _r("score"), "families")


def rank_pipeline(s: SparkSession, sf: str) -> DataFrame:
    """Fusion, the intent boost where the request's prompt asks for it, the gate and the first eight of each request."""
    fused = cut(ranking.implementation_intent(ranking.log_odds_fusion(_ranked(s, sf)), _prompts(s, sf)))
    return ranking.top_k(ranking.gate(fused), 8).select("request_id", "target", _r("score"), F.col("place").cast("bigint").alias("place"))


def _prompts(s: SparkSession, sf: str) -> DataFrame:
    """A prompt for each request: the items in turn."""
    items = table(s, sf, "eval_prompts").select("item_id", "prompt").distinct()
    return _ranked(s, sf).select("request_id").distinct().join(items, F.col("request_id") % 240 + 1 == F.col("item_id")).select("request_id", "prompt")


def symbol_affinity(s: SparkSession, sf: str) -> DataFrame:
    fused = ranking.log_odds_fusion(_ranked(s, sf).where("target_type = 'symbol'"))
    return ranking.symbol_affinity(fused).select("request_id", "path", _r("boost"))


def import_affinity(s: SparkSession, sf: str) -> DataFrame:
    e = _edges(s, sf)
    anchors = e.select(F.col("dst").alias("node")).where("node % 20 = 0").distinct().withColumn("score", 1.2 + F.col("node") / 100)
    return ranking.import_affinity(anchors, e, graph.degrees(e)).select("node", _r("boost"))


# -- graph
def _edges(s: SparkSession, sf: str) -> DataFrame:
    i = table(s, sf, "ci_imports").where("resolution = 'internal'").select("from_file_id", "to_file_id")
    return graph.simple_edges(i.select(F.col("from_file_id").alias("src"), F.col("to_file_id").alias("dst")))


def _order_edges(s: SparkSession, sf: str) -> DataFrame:
    """Consecutive parts of an order: a graph with cycles."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return graph.simple_edges(table(s, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")))


def import_coverage(s: SparkSession, sf: str) -> DataFrame:
    return graph.coverage(table(s, sf, "ci_imports").distinct())


def import_degrees(s: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(_edges(s, sf))


def blast_radius(s: SparkSession, sf: str) -> DataFrame:
    e = _edges(s, sf)
    starts = e.select(F.col("dst").alias("node")).where("node % 20 = 0")
    return graph.reach(e, starts, 4, reverse=True).select("node", F.col("hop").cast("bigint").alias("hop"))


def pagerank(s: SparkSession, sf: str) -> DataFrame:
    return graph.pagerank(_edges(s, sf)).select("node", _r("rank", 7))


def personalised_walk(s: SparkSession, sf: str) -> DataFrame:
    e = _edges(s, sf).withColumn("weight", F.lit(1.0))
    anchors = e.select(F.col("dst").alias("node")).where("node % 20 = 0").distinct().withColumn("weight", 1.0 + F.col("node") % 3)
    return graph.walk_with_restart(e, anchors).select("node", _r("score", 8))


def components(s: SparkSession, sf: str) -> DataFrame:
    return graph.connected(_edges(s, sf))


def strong_components(s: SparkSession, sf: str) -> DataFrame:
    return graph.strong_components(_order_edges(s, sf))


def condensation_layers(s: SparkSession, sf: str) -> DataFrame:
    e = cut(_order_edges(s, sf))
    return graph.layers(e, cut(graph.strong_components(e))).select("component", F.col("layer").cast("bigint").alias("layer"))


def label_communities(s: SparkSession, sf: str) -> DataFrame:
    return graph.label_propagation(_edges(s, sf))


def modularity(s: SparkSession, sf: str) -> DataFrame:
    e = _edges(s, sf)
    return graph.modularity(e, graph.nodes_of(e).withColumn("label", F.col("node") % 7)).select(_r("q"))


# -- navigation and sources
def enclosing_symbols(s: SparkSession, sf: str) -> DataFrame:
    points = table(s, sf, "ci_symbols").select("file_id", (F.col("line_start") + 1).alias("line")).distinct()
    return navigation.enclosing_symbols(points, table(s, sf, "ci_symbols")).select("file_id", F.col("line").cast("bigint").alias("line"), "symbol_id")


def project_overview(s: SparkSession, sf: str) -> DataFrame:
    return navigation.overview(table(s, sf, "ci_files"))


def find_tests(s: SparkSession, sf: str) -> DataFrame:
    f = table(s, sf, "ci_files")
    return navigation.find_tests(f, f, table(s, sf, "ci_imports").select("id", "from_file_id", "to_file_id"))


def index_status(s: SparkSession, sf: str) -> DataFrame:
    return navigation.index_status(table(s, sf, "ci_files"), table(s, sf, "ci_symbols"), table(s, sf, "ci_imports"))


def file_outline(s: SparkSession, sf: str) -> DataFrame:
    return navigation.outline(table(s, sf, "ci_symbols")).select("file_id", F.col("place").cast("bigint").alias("place"), "name", "kind")


def test_paths(s: SparkSession, sf: str) -> DataFrame:
    p = text.plain_path(F.col("path"))
    return table(s, sf, "fts_files").select("file_id", p.alias("path")).distinct().select("file_id", text.is_test_path(F.col("path")).alias("ranker"), text.looks_like_test(F.col("path")).alias("search"))


def file_languages(s: SparkSession, sf: str) -> DataFrame:
    return table(s, sf, "ci_files").select("id", "path").distinct().select("id", tree.language_of(F.col("path")).alias("language"))


QUERIES = {
    f.__name__: f
    for f in (
        cochange_partners, cochange_hidden, log_odds_profile, shared_key_edges, name_postings, lexical_items, symbol_scores, grep_literal, literal_content,
        bm25_rank, cosine_topk, fuzzy_scores, adaptive_threshold, rank_fusion, turn_numbers, pattern_classes, reactive_scores, session_snapshot,
        base_rate_discount, cooccurrence_boost, dismissal_penalty, last_writer_wins, retract_failed, session_windows, merge_synergy, best_channel_row,
        logodds_fusion, rank_pipeline, symbol_affinity, import_affinity, import_coverage, import_degrees, blast_radius, pagerank, personalised_walk,
        components, strong_components, condensation_layers, label_communities, modularity, enclosing_symbols, project_overview, find_tests, index_status,
        file_outline, test_paths, file_languages,
    )
}
