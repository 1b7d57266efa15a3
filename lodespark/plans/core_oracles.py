"""SQL that gives the same results as the queries of the ranking, search, graph and mining operators."""

from __future__ import annotations

from lodespark.functions.text import NAME_ALIASES, NAME_STOPWORDS, PROFILE_STOPWORDS, TEST_ENDINGS
from lodespark.operators.ranking import CALIBRATION
from lodespark.sources.tree import LANGUAGE_BY_EXTENSION


def _r(x: str, name: str, digits: int = 6) -> str:
    return f"round({x} + 1e-9, {digits}) AS {name}"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


COCHANGE = """
b AS (
  SELECT o_custkey AS basket, p_brand AS item, max(o_orderdate) AS tm FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
), k AS (
  SELECT basket, power(0.5, greatest(0, (epoch(TIMESTAMP '1999-01-01') - floor(epoch(max(tm)))) / 86400.0) / 90.0) AS w FROM b GROUP BY basket HAVING count(*) <= 30
), r AS (SELECT basket, item, w FROM b JOIN k USING (basket)),
one AS (SELECT item, count(*) AS c, sum(w) AS sw FROM r GROUP BY item),
tot AS (SELECT count(*) AS n, sum(w) AS tw FROM k),
j AS (SELECT x.item AS src, y.item AS dst, count(*) AS o, sum(x.w) AS jw FROM r x JOIN r y ON x.basket = y.basket AND x.item <> y.item GROUP BY 1, 2 HAVING count(*) >= 3),
m AS (
  SELECT src, dst, o, jw, s.c AS a, s.sw AS wa, d.c AS bb, d.sw AS wb, n, tw FROM j JOIN one s ON s.item = src JOIN one d ON d.item = dst, tot
), g AS (
  SELECT *, jw / wa AS confidence, jw * tw / (wa * wb) AS lift, o::DOUBLE / a AS p,
    2 * ((CASE WHEN o > 0 THEN o * ln(o / (a::DOUBLE * bb / n)) ELSE 0 END)
       + (CASE WHEN a - o > 0 AND n > bb THEN (a - o) * ln((a - o) / (a::DOUBLE * (n - bb) / n)) ELSE 0 END)
       + (CASE WHEN bb - o > 0 AND n > a THEN (bb - o) * ln((bb - o) / ((n - a)::DOUBLE * bb / n)) ELSE 0 END)
       + (CASE WHEN n - a - bb + o > 0 THEN (n - a - bb + o) * ln((n - a - bb + o) / ((n - a)::DOUBLE * (n - bb) / n)) ELSE 0 END)) AS llr
  FROM m WHERE n - a - bb + o >= 0
), f AS (
  SELECT *, greatest(0, (p + 3.8416 / (2 * a) - 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * a)) / a)) / (1 + 3.8416 / a)) AS low FROM g
), c AS (SELECT src, dst, o AS support, confidence, low AS confidence_low, lift, llr, confidence * low / p AS strength FROM f WHERE confidence >= 0.4 AND lift > 1 AND llr >= 3.841)
"""

TERMS = f"""list_filter(string_split_regex(lower(regexp_replace(docstring, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'),
  lambda t: length(t) >= 3 AND NOT list_contains({_list(PROFILE_STOPWORDS)}, t) AND NOT regexp_matches(t, '^[0-9]+$'))"""


def _name_tokens(body: str) -> str:
    """Tokens of text whose words are each of one case, which needs no split at case changes."""
    raw = f"list_distinct(list_filter(list_transform(flatten(list_transform(regexp_extract_all(regexp_replace({body}, '[-./]', '_', 'g'), '[A-Za-z][A-Za-z0-9_]{{2,}}'), lambda w: string_split(w, '_'))), lambda t: lower(t)), lambda t: length(t) >= 3))"
    alias = " ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in NAME_ALIASES.items())
    return f"list_distinct(list_concat(list_filter({raw}, lambda t: NOT list_contains({_list(NAME_STOPWORDS)}, t)), flatten(list_transform({raw}, lambda t: CASE t {alias} ELSE [] END))))"


def _camel_tokens(body: str) -> str:
    """The same for names of any case: an upper-case run ends before another capital or at the end of its piece."""
    split = "string_split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g'), '[A-Z]([0-9])', ' \\1', 'g')), ' ')"
    words = f"regexp_extract_all(regexp_replace({body}, '[-./]', '_', 'g'), '[A-Za-z][A-Za-z0-9_]{{2,}}')"
    raw = f"list_distinct(list_filter(list_transform(flatten(list_transform(flatten(list_transform({words}, lambda w: string_split(w, '_'))), lambda p: {split})), lambda t: lower(t)), lambda t: length(t) >= 3))"
    alias = " ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in NAME_ALIASES.items())
    return f"list_distinct(list_concat(list_filter({raw}, lambda t: NOT list_contains({_list(NAME_STOPWORDS)}, t)), flatten(list_transform({raw}, lambda t: CASE t {alias} ELSE [] END))))"


EVENTS = """
e AS (
  SELECT user_id AS session, event_id AS id, ts AS tm, props->>'$.k' AS target,
    CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'retrieved' WHEN 'purchase' THEN 'edit' WHEN 'signup' THEN 'cited' ELSE 'dismissed' END AS kind
  FROM events
)
"""
TURNS = (
    EVENTS
    + """, t0 AS (
  SELECT *, row_number() OVER w AS iteration, CAST(sum(CASE WHEN kind = 'cited' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS turn FROM e
  WINDOW w AS (PARTITION BY session ORDER BY tm, id ROWS UNBOUNDED PRECEDING)
), t AS (SELECT *, CASE WHEN turn > 0 THEN greatest(1, max(turn) OVER (PARTITION BY session) - turn) END AS distance FROM t0)
"""
)


def _patterns(rows: str, name: str) -> str:
    return f"""{name}0 AS (
  SELECT session, target, count(*) FILTER (kind = 'cited') AS cited, count(*) FILTER (kind = 'dismissed') AS dismissed, count(*) FILTER (kind IN ('read', 'retrieved')) AS reads,
    count(*) FILTER (kind = 'edit') AS edits, max(CASE WHEN kind = 'edit' THEN 1 ELSE 0 END) AS edited FROM {rows} WHERE target IS NOT NULL GROUP BY 1, 2
), {name} AS (
  SELECT session, target, CASE WHEN cited > 0 THEN 'cited' WHEN dismissed > 0 THEN 'dismissed' WHEN reads > 0 AND edits > 0 THEN 'read_edit' WHEN edits > 0 THEN 'edit_only'
    WHEN reads >= 3 THEN 'read_repeated' WHEN reads > 0 AND sum(edited) OVER (PARTITION BY session) - edited > 0 THEN 'read_skipped' ELSE 'neutral' END AS pattern FROM {name}0
)"""


REACTIVE = (
    TURNS
    + """, x AS (SELECT * FROM (SELECT *, max(iteration) OVER (PARTITION BY session) AS now FROM t) WHERE iteration >= greatest(0, now - 30) AND target IS NOT NULL),
raw AS (
  SELECT session, target, sum(CASE kind WHEN 'read' THEN 1.0 WHEN 'retrieved' THEN 0.5 WHEN 'edit' THEN 2.0 WHEN 'cited' THEN 2.5 ELSE -1.0 END
    * exp(-0.15 * (now - iteration)) * coalesce(power(0.5, greatest(1, distance) - 1), 1.0)) AS raw FROM x GROUP BY 1, 2
), """
    + _patterns("x", "pt")
    + """, capped AS (
  SELECT session, target, pattern, CASE WHEN pattern = 'read_repeated' THEN least(raw, 1.0) ELSE raw END AS kept,
    CASE pattern WHEN 'cited' THEN 1.5 WHEN 'read_edit' THEN 2.0 WHEN 'edit_only' THEN 1.5 WHEN 'neutral' THEN 1.0 WHEN 'read_repeated' THEN 0.7 ELSE 0.3 END AS factor
  FROM raw JOIN pt USING (session, target)
), reactive AS (SELECT session, target, pattern, kept, kept * factor AS score FROM capped WHERE kept * factor > 0)
"""
)

RANKED = """
ri AS (SELECT DISTINCT request_id, target, target_type, score, reason, ord FROM ranked_items WHERE score IS NOT NULL AND CAST(score AS VARCHAR) NOT IN ('nan', 'inf', '-inf') AND target IS NOT NULL AND request_id IS NOT NULL)
"""
_CALIB = " ".join(f"WHEN '{k}' THEN 1 / (1 + exp(-(0.2 + 2.0 * least(1, greatest(0, (score - {lo}) / ({hi} - {lo}))))))" for k, (_, lo, hi) in CALIBRATION.items())
_FAMILY = " ".join(f"WHEN '{k}' THEN '{f}'" for k, (f, _, _) in CALIBRATION.items())
FUSED = (
    RANKED
    + f""", pf AS (SELECT *, split_part(split_part(reason, ':', 1), ' ', 1) AS prefix FROM ri),
pp AS (SELECT request_id, target, target_type, CASE prefix {_FAMILY} ELSE 'nametext' END AS family,
  CASE prefix {_CALIB} ELSE 1 / (1 + exp(-(0.2 + 2.0 * least(1, greatest(0, (score - 0.3) / 4.2))))) END AS p FROM pf WHERE reason IS NOT NULL),
"""
)


def _fused(where: str) -> str:
    return (
        FUSED
        + f"""fam AS (SELECT request_id, target, family, 1 - exp(sum(ln(1 - p))) AS p FROM pp WHERE {where} GROUP BY ALL),
fused AS (
  SELECT request_id, target, greatest(0.0, 1.6 * sum((CASE family WHEN 'behavioral' THEN 1.15 ELSE 1.0 END) * ln(least(1 - 1e-6, greatest(1e-6, p)) / (1 - least(1 - 1e-6, greatest(1e-6, p)))))) AS score,
    count(*) AS families FROM fam GROUP BY ALL
)
"""
    )


EDGES = "ed AS (SELECT DISTINCT from_file_id AS src, to_file_id AS dst FROM ci_imports WHERE resolution = 'internal' AND to_file_id IS NOT NULL AND from_file_id <> to_file_id)"
NODES = EDGES + ", nd AS (SELECT src AS node FROM ed UNION SELECT dst FROM ed)"
PR = " ".join(
    f""", pr{i} AS MATERIALIZED (
  SELECT node, 0.15 / n + 0.85 * (coalesce(got, 0) + loose / n) AS rank FROM nd LEFT JOIN (SELECT dst, sum(rank / o) AS got FROM ed JOIN pr{i - 1} ON node = src JOIN od USING (src) GROUP BY dst) ON dst = node,
    (SELECT count(*) AS n FROM nd), (SELECT coalesce(sum(rank), 0) AS loose FROM pr{i - 1} WHERE node NOT IN (SELECT src FROM ed)))"""
    for i in range(1, 41)
)
WALK = " ".join(
    f""", w{i} AS MATERIALIZED (SELECT node, sum(score) AS score FROM (
  SELECT st.dst AS node, st.p * w.score * 0.8 AS score FROM st JOIN w{i - 1} w ON w.node = st.src UNION ALL SELECT node, s * 0.2 FROM seed) GROUP BY node)"""
    for i in range(1, 4)
)
_EXT = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGE_BY_EXTENSION.items())
_ENDS = " OR ".join(f"ends_with(low, '{e}')" for e in TEST_ENDINGS)
LOOKS_LIKE_TEST = f"""(len(list_intersect(string_split(lower(path), '/'), ['test', 'tests', 'spec', '__tests__'])) > 0 OR starts_with(low, 'test_') OR {_ENDS}
  OR regexp_matches(name, '(Test|Tests|Spec|Specs)\\.(java|cs|kt|kts|JAVA|CS|KT|KTS|Java)$'))"""
PATHS = "SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name, lower(regexp_extract(path, '([^/]*)$', 1)) AS low"
_DOT = "list_dot_product(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"
SIMS = f"""qs AS (SELECT DISTINCT vec_id AS query, embedding AS q, label FROM embeddings WHERE vec_id % 20 = 0),
sims AS (SELECT query, vec_id AS id, {_DOT.format("embedding", "q")} / sqrt({_DOT.format("embedding", "embedding")} * {_DOT.format("q", "q")}) AS sim FROM embeddings, qs)"""

_TERMS3 = ["catch", "items", "return"]
BM25 = (
    "WITH d AS (SELECT DISTINCT file_id AS id, body FROM fts_files WHERE body IS NOT NULL), t AS (SELECT id, regexp_extract_all(lower(body), '[\\p{L}\\p{N}_.\\-]+') AS t FROM d), c AS (SELECT id, len(t) AS len, "
    + ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(_TERMS3))
    + " FROM t), s AS (SELECT count(*) AS n, avg(len) AS mean, "
    + ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(3))
    + " FROM c) SELECT id, "
    + _r(" + ".join(f"greatest(1e-6, ln((n - df{i} + 0.5) / (df{i} + 0.5))) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(3)), "score")
    + " FROM c, s WHERE tf0 > 0 OR tf1 > 0 OR tf2 > 0"
)

ORACLES = {
    "cochange_partners": "WITH " + COCHANGE + "SELECT src, dst, support, " + ", ".join(_r(c, c) for c in ("confidence", "confidence_low", "lift", "llr", "strength")) + " FROM c",
    "cochange_hidden": "WITH "
    + COCHANGE
    + """, pt AS (SELECT DISTINCT p_type, p_brand FROM part WHERE p_size = 1), l AS (SELECT DISTINCT x.p_brand AS s, y.p_brand AS d FROM pt x JOIN pt y USING (p_type) WHERE x.p_brand <> y.p_brand),
h AS (SELECT src, dst, strength, EXISTS (SELECT 1 FROM l WHERE l.s = src AND l.d = dst) AS linked FROM c)
SELECT src, dst, linked, place, """
    + _r("strength", "strength")
    + " FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY linked, strength DESC, dst) AS place FROM h) WHERE place <= 3",
    "log_odds_profile": f"""
WITH d AS (SELECT lower(trim(kind)) AS kind, docstring FROM (SELECT DISTINCT id, kind, docstring FROM ci_symbols) WHERE kind IS NOT NULL),
c AS (SELECT kind, term, count(*) AS n FROM (SELECT kind, unnest({TERMS}) AS term FROM d) GROUP BY 1, 2),
x AS (SELECT kind, term, n, sum(n) OVER (PARTITION BY kind) AS gn, sum(n) OVER (PARTITION BY term) AS tn, sum(n) OVER () AS an FROM c),
y AS (SELECT *, n + 1000.0 * tn / an AS nt, tn - n + 1000.0 * tn / an AS rt FROM x),
z AS (SELECT kind, term, n, gn, (ln(nt / (gn + 1000.0 - nt)) - ln(rt / (an - gn + 1000.0 - rt))) / sqrt(1 / nt + 1 / rt) AS z FROM y WHERE gn + 1000.0 - nt > 0 AND an - gn + 1000.0 - rt > 0 AND rt > 0)
SELECT kind, term, n, {_r("z", "z", 4)}, CASE WHEN gn >= 200 THEN 'strong' WHEN gn >= 40 THEN 'moderate' ELSE 'thin' END AS evidence FROM z WHERE z > 0
""",
    "shared_key_edges": """
WITH r AS (SELECT DISTINCT from_file_id AS note, to_file_id AS key FROM ci_imports WHERE resolution = 'internal' AND to_file_id IS NOT NULL),
t AS (SELECT count(DISTINCT note) AS total FROM r),
k AS (SELECT key, CASE WHEN total < 8 THEN 1.0 ELSE ln((total + 1) / (df + 0.5)) END AS idf FROM (SELECT key, count(*) AS df FROM r GROUP BY key), t WHERE df > 1 AND (total < 8 OR df <= 0.5 * total))
SELECT x.note AS src, y.note AS dst, count(*) AS n, round(round(1 - power(0.5, sum(idf)), 4) + 1e-9, 6) AS weight FROM r x JOIN k USING (key) JOIN r y USING (key) WHERE x.note < y.note GROUP BY 1, 2
""",
    "name_postings": f"SELECT DISTINCT unnest({_name_tokens(chr(39).join(['p_type || ', ' ', ' || p_name']))}) AS token, p_partkey AS id FROM part",
    "lexical_items": f"""
WITH i AS (SELECT DISTINCT unnest({_name_tokens("p_name")}) AS token, p_partkey AS id FROM part),
w AS (SELECT token FROM i GROUP BY token ORDER BY count(*) DESC, token LIMIT 3)
SELECT id, count(*) AS n_matched, least(1.4, 0.6 + 0.4 * count(*))::DOUBLE AS score FROM i WHERE token IN (SELECT token FROM w) GROUP BY id
""",
    "symbol_scores": f"""
WITH t AS (SELECT id, kind, name, list_intersect({_camel_tokens("concat_ws(' ', kind, qualname, name)")}, ['ledger', 'cache', 'merge', 'method']) AS hit FROM ci_symbols WHERE id IS NOT NULL)
SELECT DISTINCT id, CAST(len(hit) AS BIGINT) AS n_matched, round(least(4.0, 0.8 + 0.5 * len(hit)
  + CASE WHEN lower(regexp_replace(name, '^_+|_+$', '', 'g')) IN ('ledger', 'cache', 'merge', 'method') THEN 1.0 ELSE 0 END
  + CASE WHEN lower(trim(kind)) IN ('ledger', 'cache', 'merge', 'method') THEN 1.2 ELSE 0 END)::DOUBLE + 1e-9, 3) AS score FROM t WHERE len(hit) > 0
""",
    "grep_literal": """
WITH d AS (SELECT DISTINCT file_id AS id, body FROM fts_files WHERE contains(body, 'ledger'))
SELECT id, CAST((length(body) - length(replace(body, 'ledger', ''))) // 6 AS BIGINT) AS matches,
  array_to_string(list_slice(list_filter(list_transform(range(1, len(string_split(body, chr(10))) + 1), lambda i: CASE WHEN contains(string_split(body, chr(10))[i], 'ledger') THEN i END), lambda i: i IS NOT NULL), 1, 5), ',') AS first_lines
FROM d
""",
    "literal_content": """
WITH d AS (SELECT DISTINCT file_id AS id, CAST(contains(lower(body), 'ledger') AS INT) + CAST(contains(lower(body), 'merge_') AS INT) + CAST(contains(lower(body), 'snapshot') AS INT) AS n FROM fts_files WHERE strlen(body) <= 262144)
SELECT id, CAST(n AS BIGINT) AS n_found, round(least(2.5, 1.15 + 0.45 * n)::DOUBLE + 1e-9, 3) AS score FROM d WHERE n > 0
""",
    "bm25_rank": BM25,
    "cosine_topk": f"WITH {SIMS} SELECT query, id, {_r('sim', 'sim')} FROM sims QUALIFY row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) <= 10",
    "fuzzy_scores": f"WITH {SIMS} SELECT query, id, {_r('(least(1.0, sim) - 0.1) * 4.5 / 0.9', 'score')} FROM sims WHERE least(1.0, sim) >= 0.1",
    "adaptive_threshold": f"WITH {SIMS} SELECT query, {_r('least(0.45, greatest(0.22, avg(sim) + 1.5 * stddev_pop(sim)))', 'threshold')} FROM sims GROUP BY query",
    "rank_fusion": f"""
WITH {SIMS}, a AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS k FROM sims),
lb AS (SELECT label, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM (SELECT DISTINCT vec_id, label FROM embeddings)),
b AS (SELECT query, id, k FROM lb JOIN qs USING (label))
SELECT query, id, {_r("sum(1.0 / (60 + k)::DOUBLE)", "score", 8)} FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2
""",
    "turn_numbers": f"WITH {TURNS} SELECT session, id, iteration, turn, CAST(distance AS BIGINT) AS distance FROM t",
    "pattern_classes": f"WITH {EVENTS}, {_patterns('e', 'pt')} SELECT * FROM pt",
    "reactive_scores": f"WITH {REACTIVE} SELECT session, target, pattern, {_r('score', 'score')} FROM reactive",
    "session_snapshot": f"WITH {REACTIVE} SELECT session, target, pattern, {_r('kept', 'score')} FROM reactive",
    "base_rate_discount": f"""WITH {REACTIVE}, n AS (SELECT count(DISTINCT session) AS n FROM reactive)
SELECT target, count(DISTINCT session) AS df, n, {_r("CASE WHEN n < 5 THEN 1.0 ELSE 1 / (1 + 4.0 * (count(DISTINCT session) + 1) / (n + 2)) END", "discount")} FROM reactive, n GROUP BY target, n""",
    "cooccurrence_boost": f"""WITH {REACTIVE}, u AS (SELECT DISTINCT session FROM reactive WHERE target IN ('3', '17', '42') AND kept >= 0.6),
h AS (SELECT target, count(DISTINCT session) AS sessions FROM reactive WHERE session IN (SELECT session FROM u) AND target NOT IN ('3', '17', '42') GROUP BY target)
SELECT target, sessions, {_r("0.8 * least(sessions / 5.0, 1.0)", "boost")} FROM h WHERE sessions >= 2 AND 0.8 * least(sessions / 5.0, 1.0) >= 0.3""",
    "dismissal_penalty": f"""WITH {EVENTS} SELECT target, count(DISTINCT session) AS dismissals, {_r("1.5 * least(count(DISTINCT session), 3) / 3.0", "penalty")}
FROM e WHERE kind = 'dismissed' AND target IS NOT NULL GROUP BY target""",
    "last_writer_wins": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "retract_failed": f"""WITH {EVENTS}, a AS (SELECT *, sum(CASE WHEN kind = 'dismissed' THEN -1 ELSE 1 END) OVER w AS su FROM e WHERE target IS NOT NULL WINDOW w AS (PARTITION BY session, target ORDER BY tm, id ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, su - least(0, min(su) OVER (PARTITION BY session, target ORDER BY tm, id ROWS UNBOUNDED PRECEDING)) AS high FROM a),
c AS (SELECT *, min(high) OVER (PARTITION BY session, target ORDER BY tm, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS low FROM b)
SELECT session, target, id FROM c WHERE kind <> 'dismissed' AND coalesce(low, high) >= high UNION ALL SELECT session, target, id FROM e WHERE target IS NULL AND kind <> 'dismissed'""",
    "session_windows": """
WITH a AS (SELECT user_id AS session, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 21600000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT session, ts, sum(fresh) OVER (PARTITION BY session ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a)
SELECT session, CAST(floor(epoch(min(ts))) AS BIGINT) AS started, CAST(floor(epoch(max(ts))) AS BIGINT) + 21600 AS ended, count(*) AS n FROM b GROUP BY session, k
""",
    "merge_synergy": f"WITH {RANKED} SELECT request_id, target, {_r('max(score) + 0.5 * (count(*) - 1)', 'score', 4)}, count(*) AS n FROM ri GROUP BY 1, 2",
    "best_channel_row": f"WITH {RANKED} SELECT request_id, target, reason, ord FROM ri QUALIFY row_number() OVER (PARTITION BY request_id, target ORDER BY score DESC, ord) = 1",
    "logodds_fusion": f"WITH {_fused('true')} SELECT request_id, target, {_r('score', 'score')}, families FROM fused",
    "rank_pipeline": f"""WITH {_fused("true")}, ask AS (SELECT item_id FROM eval_prompts WHERE regexp_matches(prompt, '(?i)\\b(implement(ed|ation|s)?|where\\s+is|where\\s+are|source|logic)\\b')
  AND NOT regexp_matches(prompt, '(?i)\\b(test|tests|testing|failing|failure|pytest|spec)\\b')), pa AS (SELECT *, lower(target) AS lt, regexp_extract(lower(target), '([^/]*)$', 1) AS nm FROM fused),
bo AS (SELECT request_id, target, CASE WHEN request_id % 240 + 1 NOT IN (SELECT item_id FROM ask) THEN score WHEN regexp_matches(lt, '(^|/)tests?/') OR starts_with(nm, 'test_') OR ends_with(nm, '_test.py') OR contains(nm, '.test.') OR contains(nm, '.spec.') THEN score * 0.45 ELSE score + 0.3 END AS score FROM pa),
ok AS (SELECT request_id FROM bo GROUP BY 1 HAVING max(score) >= 1.5)
SELECT request_id, target, {_r("score", "score")}, place FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, target) AS place FROM bo WHERE request_id IN (SELECT request_id FROM ok)) WHERE place <= 8""",
    "symbol_affinity": f"""WITH {_fused("target_type = 'symbol'")}, s AS (SELECT request_id, regexp_extract(target, '^.+ \\((.+):\\d+\\)$', 1) AS path, max(least(2.0, greatest(0.7, 0.35 * score))) AS boost FROM fused WHERE score >= 1.5 GROUP BY 1, 2)
SELECT request_id, path, {_r("boost", "boost")} FROM s WHERE path <> '' QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY boost DESC, path) <= 8""",
    "import_affinity": f"""WITH {NODES}, dg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM ed UNION ALL SELECT dst FROM ed) GROUP BY 1),
an AS (SELECT DISTINCT dst AS node, 1.2 + dst / 100.0 AS score FROM ed WHERE dst % 20 = 0),
nb AS (SELECT dst AS node, score FROM ed JOIN an ON an.node = src UNION ALL SELECT src, score FROM ed JOIN an ON an.node = dst)
SELECT node, {_r("sum(greatest(0.4, 0.25 * score) * CASE WHEN degree <= 8 THEN 1.0 ELSE greatest(0.35, 8.0 / degree) END)", "boost")} FROM nb JOIN dg USING (node) GROUP BY node""",
    "import_coverage": """
SELECT count(*) AS imports, count(to_file_id) AS internal, count(*) FILTER (resolution = 'external') AS external, count(*) FILTER (resolution = 'unresolved') AS unresolved,
  round(100.0::DOUBLE * count(to_file_id) / nullif(count(to_file_id) + count(*) FILTER (resolution = 'unresolved'), 0), 1) AS internal_pct FROM (SELECT DISTINCT * FROM ci_imports)
""",
    "import_degrees": f"WITH {NODES} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM ed UNION ALL SELECT dst FROM ed) GROUP BY 1",
    "blast_radius": f"""WITH RECURSIVE {EDGES}, r AS (SELECT DISTINCT dst AS node, 0 AS hop FROM ed WHERE dst % 20 = 0 UNION SELECT ed.src, hop + 1 FROM r JOIN ed ON ed.dst = r.node WHERE hop < 4)
SELECT node, CAST(min(hop) AS BIGINT) AS hop FROM r GROUP BY node""",
    "pagerank": f"WITH {NODES}, od AS (SELECT src, count(*) AS o FROM ed GROUP BY 1), pr0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nd) AS rank FROM nd){PR} SELECT node, {_r('rank', 'rank', 7)} FROM pr40",
    "personalised_walk": f"""WITH {EDGES}, sy AS (SELECT src, dst, count(*)::DOUBLE AS w FROM (SELECT src, dst FROM ed UNION ALL SELECT dst, src FROM ed) GROUP BY 1, 2),
st AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM sy), an AS (SELECT DISTINCT dst AS node, 1.0 + dst % 3 AS weight FROM ed WHERE dst % 20 = 0),
seed AS (SELECT node, weight::DOUBLE / (SELECT sum(weight) FROM an) AS s FROM an), w0 AS (SELECT node, s AS score FROM seed){WALK} SELECT node, {_r("score", "score", 8)} FROM w3""",
    "components": f"""WITH RECURSIVE {NODES}, sy AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed), r AS (SELECT node, node AS component FROM nd UNION SELECT sy.dst, r.component FROM r JOIN sy ON sy.src = r.node WHERE r.component < sy.dst)
SELECT node, min(component) AS component FROM r GROUP BY node""",
    "modularity": f"""WITH {EDGES}, sy AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed),
c AS (SELECT src % 7 AS a, count(*) AS ends, count(*) FILTER (src % 7 = dst % 7) AS inside FROM sy GROUP BY 1)
SELECT {_r("sum(inside)::DOUBLE / sum(ends) - sum(ends::DOUBLE * ends) / (sum(ends)::DOUBLE * sum(ends))", "q")} FROM c""",
    "enclosing_symbols": """
WITH s AS (SELECT DISTINCT id, file_id, line_start, line_end FROM ci_symbols WHERE line_start IS NOT NULL AND line_end >= line_start), p AS (SELECT DISTINCT file_id, line_start + 1 AS line FROM ci_symbols)
SELECT file_id, CAST(line AS BIGINT) AS line, id AS symbol_id FROM p JOIN s USING (file_id) WHERE line BETWEEN line_start AND line_end
QUALIFY row_number() OVER (PARTITION BY file_id, line ORDER BY line_end - line_start, line_start DESC, id) = 1
""",
    "project_overview": f"""
WITH f AS (SELECT regexp_replace(path, '^(\\./)+', '') AS path, language, symbol_count FROM (SELECT DISTINCT ON (id) * FROM ci_files ORDER BY id, path DESC NULLS LAST, language DESC NULLS LAST, symbol_count DESC NULLS LAST)), g AS ({PATHS} FROM f)
SELECT string_split(path, '/')[1] AS top, coalesce(lower(trim(language)), 'unknown') AS language, count(*) AS files, CAST(sum(coalesce(symbol_count, 0)) AS BIGINT) AS symbols, count(*) FILTER ({LOOKS_LIKE_TEST}) AS tests FROM g GROUP BY 1, 2
""",
    "find_tests": f"""
WITH f0 AS (SELECT id, max(regexp_replace(path, '^(\\./)+', '')) AS path FROM ci_files WHERE id IS NOT NULL AND path IS NOT NULL GROUP BY id), f1 AS ({PATHS} FROM f0),
f AS (SELECT *, string_split(path, '/')[1] AS repo, CASE WHEN length(name) > 1 AND contains(substr(name, 2), '.') THEN regexp_replace(name, '\\.[^.]*$', '') ELSE name END AS stem, {LOOKS_LIKE_TEST} AS is_test FROM f1),
w AS (SELECT *, lower(stem) AS ls, list_filter(list_distinct(list_filter(string_split_regex(lower(regexp_replace(stem, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')),
  lambda x: NOT list_contains(['test', 'tests', 'spec', 'specs', 'it', 'should'], x)) AS words FROM f),
nm AS (SELECT a.id AS target_id, b.id AS test_id, 3.0 AS s FROM w a JOIN w b ON b.is_test AND a.repo = b.repo AND b.ls IN ('test_' || a.ls, a.ls || '_test', a.ls || '_spec', a.ls || '.test', a.ls || '.spec', a.ls || 'test', a.ls || 'tests', a.ls || 'spec')),
tk AS (SELECT a.id AS target_id, b.id AS test_id, 2.0 AS s FROM w a JOIN w b ON b.is_test AND a.repo = b.repo AND len(a.words) > 0 AND len(list_intersect(a.words, b.words)) = len(a.words)
  WHERE a.ls NOT IN ('__init__', '__main__', 'index', 'main', 'mod', 'app', 'lib', 'setup', 'types', 'utils', 'helpers', 'common', 'base', 'core', 'conftest')),
n2 AS (SELECT target_id, test_id, max(s) AS s FROM (SELECT * FROM nm UNION ALL SELECT * FROM tk) GROUP BY 1, 2),
im AS (SELECT i.to_file_id AS target_id, i.from_file_id AS test_id, 1.0 AS s FROM (SELECT DISTINCT id, from_file_id, to_file_id FROM ci_imports) i JOIN w a ON a.id = i.to_file_id JOIN w b ON b.id = i.from_file_id AND b.is_test)
SELECT target_id, test_id, sum(s)::DOUBLE AS score FROM (SELECT * FROM n2 UNION ALL SELECT * FROM im) GROUP BY 1, 2
""",
    "index_status": """
SELECT (SELECT count(DISTINCT id) FROM ci_files) AS files, (SELECT count(DISTINCT id) FROM ci_files WHERE embedding IS NOT NULL) AS files_embedded, (SELECT count(DISTINCT id) FROM ci_symbols) AS symbols,
  (SELECT count(DISTINCT id) FROM ci_symbols WHERE length(trim(docstring)) > 0) AS symbols_documented, (SELECT count(DISTINCT id) FROM ci_imports) AS imports
""",
    "file_outline": """
SELECT file_id, place, name, kind FROM (SELECT file_id, name, lower(trim(kind)) AS kind, row_number() OVER (PARTITION BY file_id ORDER BY line_start, id) AS place
FROM (SELECT DISTINCT ON (id, file_id) * FROM ci_symbols)) WHERE place <= 8
""",
    "test_paths": f"""
WITH f AS (SELECT DISTINCT file_id, regexp_replace(path, '^(\\./)+', '') AS path FROM fts_files), g AS ({PATHS} FROM f)
SELECT file_id, (regexp_matches(lower(path), '(^|/)tests?/') OR starts_with(low, 'test_') OR ends_with(low, '_test.py') OR contains(low, '.test.') OR contains(low, '.spec.')) AS ranker, {LOOKS_LIKE_TEST} AS search FROM g
""",
    "file_languages": f"SELECT id, CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) {_EXT} END AS language FROM (SELECT DISTINCT id, path FROM ci_files)",
}
