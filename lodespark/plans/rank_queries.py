"""Queries of the ranking channels, boosts and the whole ranking over the evaluation prompts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.functions import text
from lodespark.operators import behaviour, boosts, channels, evaluation, graph, lexical, ranking, walks
from lodespark.plans.core_oracles import REACTIVE, _camel_tokens, _r
from lodespark.plans.core_queries import _events, _turned
from lodespark.session import cut, table

#: The time that ages are measured at: past the last event.
NOW = "2024-02-01 00:00:00"
#: The synthetic vectors are far from each other; the channels' own thresholds would leave nothing.
NEAR = 0.25


def _now():
    return F.lit(NOW).cast("timestamp")


def _prompts(s: SparkSession, sf: str) -> DataFrame:
    vec = table(s, sf, "embeddings").select(F.col("vec_id").alias("request_id"), F.col("embedding").alias("vec")).distinct()
    return table(s, sf, "eval_prompts").select(F.col("item_id").alias("request_id"), "prompt").distinct().join(vec, "request_id", "left")


def _files(s: SparkSession, sf: str) -> DataFrame:
    days = (F.unix_micros(_now()) - F.unix_micros(F.col("mtime").cast("timestamp"))) / 86_400_000_000.0
    return table(s, sf, "ci_files").distinct().select("id", text.plain_path(F.col("path")).alias("path"), F.col("embedding").alias("vec"), days.alias("days"))


def _symbols(s: SparkSession, sf: str) -> DataFrame:
    return table(s, sf, "ci_symbols").distinct().select("id", "file_id", "kind", "name", "qualname", "line_start", "line_end", "docstring", F.col("embedding").alias("vec"))


def _pathed(s: SparkSession, sf: str, df: DataFrame) -> DataFrame:
    """Targets that are numbers of files become their paths; others are left out."""
    paths = _files(s, sf).select(F.col("id").cast("string").alias("target"), "path").distinct()
    return df.join(paths, "target").drop("target").withColumnRenamed("path", "target")


def _contexts(s: SparkSession, sf: str) -> DataFrame:
    """Sign-ups stand for prompts; the vector is that of the event's number."""
    e = table(s, sf, "events").where("event_type = 'signup'").select(F.col("event_id").alias("id"), F.col("user_id").alias("session"), F.col("ts").alias("at"), (F.col("event_id") % 500).alias("vec_id"))
    return e.join(table(s, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec")).distinct(), "vec_id").drop("vec_id")


def _snapshots(s: SparkSession, sf: str) -> DataFrame:
    return behaviour.snapshot(behaviour.reactive(_turned(s, sf)))


def _intents(s: SparkSession, sf: str) -> DataFrame:
    x = _symbols(s, sf).where(F.col("vec").isNotNull() & F.col("docstring").isNotNull())
    f = _files(s, sf).select(F.col("id").alias("file_id"), "path").distinct()
    weight = F.when(F.lower(F.trim("kind")) == "class", 1.5).otherwise(1.0)
    name = F.when(F.lower(F.trim("kind")) != "class", F.coalesce("qualname", "name"))
    return x.join(f, "file_id").select("id", "path", name.alias("qualname"), "line_start", F.lit("docstring").alias("source_kind"), weight.alias("weight"), "vec")


def _notes(s: SparkSession, sf: str) -> DataFrame:
    d = table(s, sf, "documents").where("doc_kind = 'finding'").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("topic"), (F.col("doc_id") % 500).alias("vec_id")).distinct()
    return d.join(table(s, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec")).distinct(), "vec_id").drop("vec_id")


def _imports(s: SparkSession, sf: str) -> DataFrame:
    f = _files(s, sf).select("id", "path").distinct()
    i = table(s, sf, "ci_imports").where("resolution = 'internal'").distinct()
    i = i.join(f.select(F.col("id").alias("from_file_id"), F.col("path").alias("src")), "from_file_id").join(f.select(F.col("id").alias("to_file_id"), F.col("path").alias("dst")), "to_file_id")
    return i.select("src", "dst")


def _bodies(s: SparkSession, sf: str) -> DataFrame:
    return table(s, sf, "fts_files").where(F.col("body").isNotNull()).select(text.plain_path(F.col("path")).alias("target"), "body").distinct()


def _index(s: SparkSession, sf: str) -> boosts.Index:
    return boosts.Index(
        files=_files(s, sf), symbols=_symbols(s, sf), bodies=_bodies(s, sf), contexts=_contexts(s, sf), snapshots=_pathed(s, sf, _snapshots(s, sf)),
        events=_pathed(s, sf, _events(s, sf)), intents=_intents(s, sf), notes=_notes(s, sf), imports=_imports(s, sf),
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("request_id", "target", "target_type", F.round(F.col("score") + 1e-9, 6).alias("score"))


def explicit_mentions(s: SparkSession, sf: str) -> DataFrame:
    return channels.explicit_mentions(_prompts(s, sf), _files(s, sf).select("id", "path"), _symbols(s, sf).drop("vec")).select("request_id", "target", "target_type", "score", "reason")


def similar_prompts(s: SparkSession, sf: str) -> DataFrame:
    x = channels.similar_prompts(_prompts(s, sf), _contexts(s, sf), _now(), threshold=NEAR)
    return x.select("request_id", "session", F.round(F.col("sim") + 1e-9, 6).alias("sim"), F.round(F.col("days") + 1e-9, 4).alias("days"))


def predictive_scores(s: SparkSession, sf: str) -> DataFrame:
    return _rounded(channels.predictive(channels.similar_prompts(_prompts(s, sf), _contexts(s, sf), _now(), threshold=NEAR), _snapshots(s, sf)))


def doc_intent_best(s: SparkSession, sf: str) -> DataFrame:
    i = _intents(s, sf)
    return _rounded(channels.doc_intent(channels.prompt_similarities(_prompts(s, sf), i.select("id", "vec"), NEAR), i, threshold=NEAR))


def note_scores(s: SparkSession, sf: str) -> DataFrame:
    n = _notes(s, sf)
    return _rounded(channels.note_scores(channels.prompt_similarities(_prompts(s, sf), n.select("id", "vec"), NEAR), n, threshold=NEAR))


def context_tokens(s: SparkSession, sf: str) -> DataFrame:
    """Session documents of one source are a session's prompts."""
    d = table(s, sf, "documents").where("doc_kind IN ('session', 'prompt')").select(F.col("source").alias("session"), F.col("doc_id").alias("id"), F.col("created_at").alias("at"), F.col("text").alias("prompt")).distinct()
    return channels.context_tokens(d).select("id", "expanded", F.size("tokens").cast("bigint").alias("n_tokens"))


def lexical_files(s: SparkSession, sf: str) -> DataFrame:
    p = _prompts(s, sf).select("request_id", text.name_tokens(F.col("prompt")).alias("tokens"), F.lit(False).alias("expanded"))
    f = _files(s, sf).select("id", F.col("path").alias("target")).distinct()
    return _rounded(channels.lexical(p, lexical.postings(f, "id", F.col("target")), f, "file"))


def literal_prompt_files(s: SparkSession, sf: str) -> DataFrame:
    return _rounded(channels.literal_files(_prompts(s, sf), _bodies(s, sf)))


def _base(s: SparkSession, sf: str) -> DataFrame:
    """A first ranking of files: those that share name tokens with the prompt."""
    return lexical_files(s, sf).select("request_id", "target", "score")


def test_affinity(s: SparkSession, sf: str) -> DataFrame:
    return boosts.test_affinity(_base(s, sf), _files(s, sf).select("path")).select("request_id", "target", F.round(F.col("boost") + 1e-9, 6).alias("boost"))


def import_neighbours(s: SparkSession, sf: str) -> DataFrame:
    e = _imports(s, sf)
    return boosts.import_neighbours(_base(s, sf), e, graph.degrees(e), least=1.0).select("request_id", "target", F.round(F.col("boost") + 1e-9, 6).alias("boost"))


def cooccurrence_by_request(s: SparkSession, sf: str) -> DataFrame:
    """The anchors of a request are what its similar sessions used."""
    base = channels.predictive(channels.similar_prompts(_prompts(s, sf), _contexts(s, sf), _now(), threshold=NEAR), _snapshots(s, sf)).select("request_id", "target", F.round(F.col("score") + 1e-9, 6).alias("score"))
    return boosts.cooccurrence(cut(base), _snapshots(s, sf), least=0.3).select("request_id", "target", F.round(F.col("boost") + 1e-9, 5).alias("boost"), "sessions")


def language_intent(s: SparkSession, sf: str) -> DataFrame:
    """The directory below src stands for what a path deals with; prompts name it where they say a language."""
    p = _prompts(s, sf).select("request_id", F.concat(F.col("prompt"), F.when(F.col("request_id") % 2 == 0, " in Go or rust").otherwise("")).alias("prompt"))
    paths = _base(s, sf).withColumn("target", F.regexp_replace("target", r"^.*\.(go|rs|py)$", "parsers/$1.x"))
    paths = paths.withColumn("target", F.when(F.col("target") == "parsers/rs.x", "parsers/rust.x").when(F.col("target") == "parsers/py.x", "parsers/python.x").otherwise(F.col("target"))).groupBy("request_id", "target").agg(F.max("score").alias("score"))
    return boosts.language_intent(paths, p).select("request_id", "target", F.round(F.col("score") + 1e-9, 6).alias("score"))


def rank_prompts(s: SparkSession, sf: str) -> DataFrame:
    """The whole ranking of every evaluation prompt."""
    got = boosts.rank(_prompts(s, sf), _index(s, sf), _now(), live=_files(s, sf).select("path"))
    return got.select("request_id", "target_type", F.col("place").cast("bigint").alias("place"), "target", F.round(F.col("score") + 1e-9, 6).alias("score"))


def explain_stages(s: SparkSession, sf: str) -> DataFrame:
    return boosts.explain(_prompts(s, sf), _index(s, sf), _now()).select("request_id", "target", "stage", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("before", "after")])


def walk_boost(s: SparkSession, sf: str) -> DataFrame:
    """Imports, and the imports of each file as its commits."""
    f = _files(s, sf).select("path")
    e = _imports(s, sf)
    edges = walks.affinity_edges(e, commits=e.select(F.col("src").alias("basket"), F.col("dst").alias("item")))
    top = boosts.anchors(_base(s, sf), 1.0)
    return walks.walk_boost(top, edges, f).select("request_id", "target", F.round(F.col("boost") + 1e-9, 6).alias("boost"))


def recall_metrics(s: SparkSession, sf: str) -> DataFrame:
    """How well the files that share name tokens with the prompts meet what they expect."""
    want = table(s, sf, "eval_prompts").select(F.col("item_id").alias("request_id"), "expected_files").distinct()
    m = evaluation.retrieval_metrics(ranking.top_k(_base(s, sf), 8), want, 8)
    return m.select("cases", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("case_recall", "file_recall", "hit", "mrr", "ndcg")])


QUERIES = {
    f.__name__: f
    for f in (
        explicit_mentions, similar_prompts, predictive_scores, doc_intent_best, note_scores, context_tokens, lexical_files, literal_prompt_files, test_affinity,
        import_neighbours, cooccurrence_by_request, language_intent, rank_prompts, explain_stages, walk_boost, recall_metrics,
    )
}

_P = "p AS (SELECT DISTINCT item_id AS request_id, prompt FROM eval_prompts)"
_V = _P + ", pv AS (SELECT request_id, prompt, embedding AS v FROM p JOIN (SELECT DISTINCT vec_id, embedding FROM embeddings) ON vec_id = request_id)"
_F = "f AS (SELECT DISTINCT id, regexp_replace(path, '^(\\./)+', '') AS path FROM ci_files)"
_S = "sy AS (SELECT DISTINCT id, file_id, kind, name, qualname, line_start, line_end FROM ci_symbols)"
_EXT = "('py','pyi','rs','js','jsx','mjs','cjs','ts','tsx','go','java','md','rst','json','yaml','yml','toml','sh','sql','html','css')"


def _cos(a: str, b: str) -> str:
    d = "list_dot_product(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"
    return f"{d.format(a, b)} / (sqrt({d.format(a, a)}) * sqrt({d.format(b, b)}))"


_CTX = """c0 AS (SELECT event_id AS id, user_id AS session, ts AS tm, embedding AS w FROM events JOIN (SELECT DISTINCT vec_id, embedding FROM embeddings) ON vec_id = event_id % 500 WHERE event_type = 'signup'),
c AS (SELECT * FROM c0 ORDER BY tm DESC, id DESC LIMIT 50)"""
_SIM = f"""{_V}, {_CTX}, sm AS (SELECT * FROM (SELECT request_id, session, {_cos("v", "w")} AS sim, greatest(0.0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(tm)) / 86400000000.0) AS days FROM pv, c) WHERE sim >= {NEAR})"""
_PRED = f"""{REACTIVE}, {_SIM}, pr AS (SELECT request_id, target, least(6.0, 4.0 * sum(sim * sim * exp(-days / 14.0) * kept * CASE pattern WHEN 'cited' THEN 1.5 WHEN 'read_edit' THEN 2.0 WHEN 'edit_only' THEN 1.5 WHEN 'neutral' THEN 1.0
  WHEN 'read_repeated' THEN 0.7 ELSE 0.3 END)) AS score FROM sm JOIN reactive USING (session) WHERE target IS NOT NULL GROUP BY 1, 2)"""
_FINE = "len({0}) = 64 AND len(list_filter({0}, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter({0}, lambda x: x <> 0)) > 0"
_LEX = f"""{_P}, {_F}, pt AS (SELECT DISTINCT request_id, unnest({_camel_tokens("prompt")}) AS token FROM p), ft AS (SELECT DISTINCT id, unnest({_camel_tokens("path")}) AS token FROM f),
lx AS (SELECT request_id, path AS target, round(least(1.4, 0.6 + 0.4 * count(DISTINCT token))::DOUBLE + 1e-9, 6) AS score FROM pt JOIN ft USING (token) JOIN f USING (id) GROUP BY request_id, id, path)"""
_ANCHORS = "an AS (SELECT * FROM lx WHERE score >= 1.0 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, target) <= 5)"
_RANKER_TEST = "(regexp_matches(lower({0}), '(^|/)tests?/') OR starts_with(lower(regexp_extract({0}, '([^/]*)$', 1)), 'test_') OR ends_with(lower({0}), '_test.py') OR contains(lower(regexp_extract({0}, '([^/]*)$', 1)), '.test.') OR contains(lower(regexp_extract({0}, '([^/]*)$', 1)), '.spec.'))"

_WALK = " ".join(
    f""", w{i} AS MATERIALIZED (SELECT request_id, node, sum(p0) AS p0 FROM (SELECT request_id, st.dst AS node, st.p * p0 * 0.2 AS p0 FROM w{i - 1} JOIN st ON st.src = node UNION ALL SELECT request_id, node, s * 0.8 FROM sd) GROUP BY 1, 2)"""
    for i in range(1, 4)
)

ORACLES = {
    "explicit_mentions": f"""
WITH {_P}, {_F}, {_S}, m0 AS (SELECT request_id, unnest(regexp_extract_all(prompt, '\\b[\\w./\\-]+\\.[a-zA-Z]{{1,5}}\\b(?::\\d+(?:-\\d+)?)?')) AS m FROM p),
m AS (SELECT DISTINCT request_id, split_part(m, ':', 1) AS base FROM m0 WHERE lower(regexp_extract(split_part(m, ':', 1), '\\.([^.]*)$', 1)) IN {_EXT}),
t AS (SELECT DISTINCT request_id, trim(regexp_replace(trim(x), '[()]+$', '')) AS token FROM (SELECT request_id, unnest(list_concat(list_concat(regexp_extract_all(prompt, '`([^`\\n]+)`', 1),
  regexp_extract_all(regexp_replace(prompt, '`[^`\\n]+`', ' ', 'g'), '\\b([A-Z][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)?)\\b', 1)), regexp_extract_all(prompt, '\\b[A-Za-z_][A-Za-z0-9_]*_[A-Za-z0-9_]*\\b'))) AS x FROM p)),
nm AS (SELECT request_id, coalesce(qualname, name) || ' (' || path || ':' || line_start || ')' AS target, path FROM t JOIN sy ON sy.name = token OR sy.qualname = token JOIN f ON f.id = sy.file_id WHERE length(token) BETWEEN 3 AND 80)
SELECT request_id, path AS target, 'file' AS target_type, 5.0::DOUBLE AS score, 'explicit-mention' AS reason FROM m JOIN f ON f.path = base OR ends_with(f.path, '/' || base)
UNION ALL SELECT request_id, target, 'symbol', 5.5, 'explicit-mention' FROM nm
UNION ALL SELECT request_id, path, 'file', 3.5, 'explicit-symbol-mention' FROM nm WHERE (request_id, path) NOT IN (SELECT request_id, base FROM m)
""",
    "similar_prompts": f"WITH {_SIM} SELECT request_id, session, {_r('sim', 'sim')}, {_r('days', 'days', 4)} FROM sm",
    "predictive_scores": f"WITH {_PRED} SELECT request_id, target, 'file' AS target_type, {_r('score', 'score')} FROM pr WHERE score > 0",
    "doc_intent_best": f"""
WITH {_V}, {_F}, i AS (SELECT DISTINCT s.id, path, CASE WHEN lower(trim(kind)) <> 'class' THEN coalesce(qualname, name) END AS qualname, line_start, CASE WHEN lower(trim(kind)) = 'class' THEN 1.5 ELSE 1.0 END AS weight, s.embedding AS w
  FROM ci_symbols s JOIN f ON f.id = s.file_id WHERE s.docstring IS NOT NULL AND {_FINE.format("s.embedding")}),
x AS (SELECT request_id, path, qualname, line_start, (sim - {NEAR}) / (1 - {NEAR}) * weight AS b FROM (SELECT *, {_cos("v", "w")} AS sim FROM pv, i) WHERE sim >= {NEAR}),
r AS (SELECT request_id, path AS target, 'file' AS target_type, 3.2 * b AS score FROM x WHERE qualname IS NULL UNION ALL SELECT request_id, qualname || ' (' || path || ':' || line_start || ')', 'symbol', 3.6 * b FROM x WHERE qualname IS NOT NULL
  UNION ALL SELECT request_id, path, 'file', 3.6 * b * 0.65 FROM x WHERE qualname IS NOT NULL)
SELECT request_id, target, target_type, {_r("max(score)", "score")} FROM r GROUP BY 1, 2, 3
""",
    "note_scores": f"""
WITH {_V}, n AS (SELECT DISTINCT doc_id, embedding AS w FROM documents JOIN embeddings ON vec_id = doc_id % 500 WHERE doc_kind = 'finding')
SELECT request_id, CAST(doc_id AS VARCHAR) AS target, 'finding' AS target_type, {_r(f"(sim - {NEAR}) * 3.5 / (1 - {NEAR})", "score")} FROM (SELECT *, {_cos("v", "w")} AS sim FROM pv, n) WHERE sim >= {NEAR}
""",
    "lexical_files": f"WITH {_LEX} SELECT request_id, target, 'file' AS target_type, score FROM lx",
    "test_affinity": f"""
WITH {_LEX}, {_ANCHORS}, e AS (SELECT DISTINCT path, regexp_extract(path, '([^/]*)$', 1) AS name, {_RANKER_TEST.format("path")} AS test FROM f),
a AS (SELECT *, {_RANKER_TEST.format("target")} AS test, regexp_replace(regexp_extract(target, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem FROM an),
fw AS (SELECT DISTINCT request_id, a.target, score, path FROM a JOIN e ON e.name IN ('test_' || stem || '.py', stem || '_test.py', stem || '.test.py', 'test_' || stem || '.ts', stem || '.test.ts', stem || '.spec.ts', 'test_' || stem || '.js', stem || '.test.js', stem || '.spec.js')
  OR (e.test AND contains(lower(e.name), lower(stem))) WHERE NOT a.test AND stem <> '' AND NOT starts_with(stem, 'test_')),
b0 AS (SELECT *, regexp_replace(regexp_replace(stem, '(\\.test|\\.spec|_test)$', ''), '^test_', '') AS st FROM a WHERE test),
bw AS (SELECT DISTINCT request_id, b0.target, score, path FROM b0 JOIN e ON NOT e.test AND e.name IN (st || '.py', st || '.pyi', st || '.ts', st || '.tsx', st || '.js', st || '.jsx', st || '.go', st || '.rs', st || '.java') WHERE st <> '')
SELECT request_id, path AS target, {_r("sum(boost)", "boost")} FROM (SELECT request_id, path, greatest(0.5, 0.35 * score) AS boost FROM fw UNION ALL SELECT request_id, path, greatest(1.0, 0.35 * score) FROM bw) GROUP BY 1, 2
""",
    "import_neighbours": f"""
WITH {_LEX}, {_ANCHORS}, e AS (SELECT a.path AS src, b.path AS dst FROM (SELECT DISTINCT * FROM ci_imports WHERE resolution = 'internal') i JOIN f a ON a.id = i.from_file_id JOIN f b ON b.id = i.to_file_id),
dg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e WHERE src <> dst) GROUP BY 1),
nb AS (SELECT request_id, dst AS node, score FROM e JOIN an ON target = src WHERE src <> dst UNION ALL SELECT request_id, src, score FROM e JOIN an ON target = dst WHERE src <> dst)
SELECT request_id, node AS target, {_r("sum(greatest(0.4, 0.25 * score) * CASE WHEN degree <= 8 THEN 1.0 ELSE greatest(0.35, 8.0 / degree) END)", "boost")} FROM nb JOIN dg USING (node) GROUP BY 1, 2
""",
    "cooccurrence_by_request": f"""
WITH {_PRED}, an AS (SELECT request_id, target, round(score + 1e-9, 6) AS score FROM pr WHERE round(score + 1e-9, 6) >= 0.3 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY round(score + 1e-9, 6) DESC, target) <= 5),
u AS (SELECT DISTINCT request_id, session FROM reactive JOIN an USING (target) WHERE kept >= 0.3), mn AS (SELECT request_id, avg(score) AS mean FROM an GROUP BY 1),
h AS (SELECT request_id, r.target, count(DISTINCT session) AS sessions FROM u JOIN reactive r USING (session) WHERE (request_id, r.target) NOT IN (SELECT request_id, target FROM an) GROUP BY 1, 2 HAVING count(DISTINCT session) >= 2)
SELECT request_id, target, {_r("mean * 0.4 * least(sessions / 5.0, 1.0)", "boost", 5)}, sessions FROM h JOIN mn USING (request_id) WHERE mean * 0.4 * least(sessions / 5.0, 1.0) >= 0.3
""",
    "language_intent": f"""
WITH {_LEX}, q AS (SELECT request_id, CASE WHEN request_id % 2 = 0 THEN prompt || ' in Go or rust' ELSE prompt END AS prompt FROM p),
w AS (SELECT request_id, list_transform(regexp_extract_all(prompt, '[A-Za-z][A-Za-z0-9_+-]*'), lambda x: lower(x)) AS w FROM q),
k AS (SELECT request_id, list_filter(['c', 'go', 'java', 'javascript', 'python', 'rust', 'typescript'], lambda l: len(list_intersect(w, CASE l WHEN 'go' THEN ['go', 'golang'] WHEN 'javascript' THEN ['javascript', 'js'] WHEN 'python' THEN ['python', 'py']
  WHEN 'rust' THEN ['rust', 'rs'] WHEN 'typescript' THEN ['typescript', 'ts'] ELSE [l] END)) > 0) AS k FROM w),
b AS (SELECT request_id, CASE WHEN regexp_matches(target, '\\.go$') THEN 'parsers/go.x' WHEN regexp_matches(target, '\\.rs$') THEN 'parsers/rust.x' WHEN regexp_matches(target, '\\.py$') THEN 'parsers/python.x' ELSE target END AS target, max(score) AS score FROM lx GROUP BY 1, 2),
l AS (SELECT b.*, k, regexp_extract(target, '^(?:.*/)?parsers/(?:test_)?([a-z]+)', 1) AS lang FROM b JOIN k USING (request_id))
SELECT request_id, target, {_r("CASE WHEN len(k) = 0 OR lang NOT IN ('c', 'go', 'java', 'javascript', 'python', 'rust', 'typescript') THEN score WHEN list_contains(k, lang) THEN score + 0.4 ELSE score * 0.55 END", "score")} FROM l
""",
    "walk_boost": f"""
WITH {_LEX}, {_ANCHORS}, e AS (SELECT a.path AS src, b.path AS dst FROM (SELECT DISTINCT * FROM ci_imports WHERE resolution = 'internal') i JOIN f a ON a.id = i.from_file_id JOIN f b ON b.id = i.to_file_id),
bk AS (SELECT DISTINCT src AS basket, dst AS item FROM e), bs AS (SELECT basket, count(*) AS n FROM bk GROUP BY 1 HAVING count(*) BETWEEN 2 AND 25),
ae AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, 1.0::DOUBLE AS w FROM e UNION ALL SELECT x.item, y.item, 1.2::DOUBLE / (n - 1) FROM bk x JOIN bk y ON x.basket = y.basket AND x.item < y.item JOIN bs ON bs.basket = x.basket) WHERE src <> dst GROUP BY 1, 2),
sy AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w FROM ae UNION ALL SELECT dst, src, w FROM ae) GROUP BY 1, 2), st AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM sy),
sd AS (SELECT request_id, target AS node, score / sum(score) OVER (PARTITION BY request_id) AS s FROM an), w0 AS (SELECT request_id, node, s AS p0 FROM sd){_WALK},
nw AS (SELECT * FROM w3 WHERE p0 > 0 AND (request_id, node) NOT IN (SELECT request_id, node FROM sd) QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY p0 DESC, node) <= 3)
SELECT request_id, node AS target, round(0.6 * p0 / best + 1e-9, 6) AS boost FROM (SELECT *, max(p0) OVER (PARTITION BY request_id) AS best FROM nw) WHERE p0 >= 0.4 * best
""",
    "recall_metrics": f"""
WITH {_LEX}, t AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, target) AS place FROM lx QUALIFY place <= 8),
w AS (SELECT DISTINCT item_id AS request_id, list_distinct(expected_files) AS e FROM eval_prompts WHERE len(expected_files) > 0),
j AS (SELECT w.request_id, len(e) AS n, place, list_contains(e, target) AS good FROM w LEFT JOIN t USING (request_id)),
c AS (SELECT request_id, any_value(n) AS n, count(*) FILTER (good) AS hits, coalesce(max(1.0 / place) FILTER (good), 0) AS rr, coalesce(sum(1 / log2(place + 1)) FILTER (good), 0) AS dcg FROM j GROUP BY 1),
i AS (SELECT *, (SELECT sum(1 / log2(g + 1)) FROM range(1, 9) x(g) WHERE g <= n) AS best FROM c)
SELECT count(*) AS cases, {_r("avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0 END)", "case_recall")}, {_r("sum(hits) / sum(n)::DOUBLE", "file_recall")}, {_r("avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0 END)", "hit")}, {_r("avg(rr)", "mrr")}, {_r("avg(dcg / best)", "ndcg")} FROM i
""",
}
