"""Ranking channels for many requests at once.

Every channel gives rows (request_id, target, target_type, score, reason): what it finds for each request. Symbol targets
read ``qualname (path:line)``. Prompts are a stated query set; rows of an index are never paired with each other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodespark.functions import mentions, stats, text, vectors
from lodespark.operators import behaviour, navigation, similarity

COLUMNS = ("request_id", "target", "target_type", "score", "reason")


def symbol_target(qualname: Column, path: Column, line: Column) -> Column:
    return F.concat(qualname, F.lit(" ("), path, F.lit(":"), line.cast("string"), F.lit(")"))


def _rows(df: DataFrame, target: Column, kind: str, score: Column, reason: Column | str) -> DataFrame:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return df.select("request_id", target.alias("target"), F.lit(kind).alias("target_type"), score.cast("double").alias("score"), reason.alias("reason"))


def explicit_mentions(prompts: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files 5.0, lines 6.0 (the two innermost symbols), symbols 5.5 and their files 3.5 that a prompt names.

    ``prompts``: request_id, prompt; ``files``: id, path; ``symbols``: id, file_id, name, qualname, line_start, line_end
    (each id once). A path is found by itself or as the end of a longer one; files of named symbols count only
    if the prompt doesn't name them itself. Null prompts and texts mention nothing.
    """
    p = prompts.where(F.col("prompt").isNotNull()).select("request_id", "prompt").distinct()
    ends = navigation.suffixes(files.select("id", text.plain_path(F.col("path")).alias("path")).distinct())
    plain = files.select(F.col("id").alias("file_id"), text.plain_path(F.col("path")).alias("path")).distinct()
    typed = p.select("request_id", F.explode(mentions.path_mentions(F.col("prompt"))).alias("m")).select("request_id", "m.*")
    traced = p.select("request_id", F.explode(mentions.traceback_mentions(F.col("prompt"))).alias("m")).select("request_id", "m.*").where(F.col("line").isNotNull())
    hit = typed.join(ends, F.col("base") == F.col("suffix")).select("request_id", "id", "path", "line")
    hit2 = traced.join(ends, F.col("base") == F.col("suffix")).select("request_id", "id", "path", "line")
    said = typed.select("request_id", F.col("base").alias("path")).distinct()
    new = hit2.select("request_id", "path").distinct().join(said, ["request_id", "path"], "left_anti")
    out = _rows(hit.unionByName(new.withColumn("id", F.lit(None).cast("bigint")).withColumn("line", F.lit(None).cast("bigint"))), F.col("path"), "file", F.lit(5.0), "explicit-mention")
    points = hit.where(F.col("line").isNotNull()).unionByName(hit2).select("request_id", F.col("id").alias("file_id"), "path", "line").distinct()
    around = navigation.enclosing_symbols(points.select("file_id", "line"), symbols, 2).drop("place")
    lines = points.join(around, ["file_id", "line"]).join(symbols.select(F.col("id").alias("symbol_id"), "qualname", "name", "line_start"), "symbol_id")
    lines = lines.select("request_id", symbol_target(F.coalesce("qualname", "name"), F.col("path"), F.col("line_start")).alias("t")).distinct()
    out = out.unionByName(_rows(lines, F.col("t"), "symbol", F.lit(6.0), "explicit-line-mention"))
    tokens = p.select("request_id", F.explode(mentions.identifier_mentions(F.col("prompt"))).alias("token"))
    s = symbols.select(F.col("id").alias("symbol_id"), "file_id", "name", "qualname", "line_start")
    named = tokens.join(s, F.col("token") == F.col("name")).unionByName(tokens.join(s, (F.col("token") == F.col("qualname")) & ~F.col("qualname").eqNullSafe(F.col("name"))))
    named = named.join(plain, "file_id")
    out = out.unionByName(_rows(named, symbol_target(F.coalesce("qualname", "name"), F.col("path"), F.col("line_start")), "symbol", F.lit(5.5), "explicit-mention"))
    seen = said.unionByName(hit2.select("request_id", "path")).distinct()
    return out.unionByName(_rows(named.join(seen, ["request_id", "path"], "left_anti"), F.col("path"), "file", F.lit(3.5), "explicit-symbol-mention"))


def similar_prompts(prompts: DataFrame, contexts: DataFrame, now: Column, top: int = 50, threshold: float = 0.45) -> DataFrame:
    """request_id, session, sim, days: the ``top`` latest earlier prompts that are like a request's.

    ``prompts``: request_id, vec; ``contexts``: id, session, vec, at. The latest ``top`` rows are what is compared with,
    whatever the number of contexts; vectors of other length and null ones are left out.
    """
    recent = contexts.where(F.col("vec").isNotNull() & F.col("at").isNotNull()).orderBy(F.col("at").desc(), F.col("id").desc()).limit(top)
    days = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) / 86_400_000_000.0)
    recent = recent.select("session", F.col("vec").alias("w"), days.alias("days"))
    sim = vectors.cosine(F.col("vec"), F.col("w"))
    both = prompts.where(F.col("vec").isNotNull()).crossJoin(F.broadcast(recent))  # at most ``top`` rows
    return both.select("request_id", "session", sim.alias("sim"), "days").where(F.col("sim") >= threshold)


def predictive(similar: DataFrame, snapshots: DataFrame, rates: DataFrame | None = None, scale: float = 4.0, most: float = 6.0, span: float = 14.0) -> DataFrame:
    """Files that sessions with similar prompts used: min(most, scale * sum of sim² exp(-days / span) score multiplier).

    ``snapshots``: session, target, score, pattern. With ``rates`` (target, discount) common targets count less.
    """
    x = similar.join(snapshots.where(F.col("target").isNotNull()), "session")
    value = F.col("sim") * F.col("sim") * F.exp(-F.col("days") / span) * F.col("score") * behaviour.multiplier(F.col("pattern"))
    sums = x.groupBy("request_id", "target").agg(F.sum(value).alias("v"))
    if rates is not None:
        sums = sums.join(rates.select("target", "discount"), "target", "left").withColumn("v", F.col("v") * F.coalesce("discount", F.lit(1.0)))
    return _rows(sums, F.col("target"), "file", F.least(F.lit(most), scale * F.col("v")), "predictive").where(F.col("score") > 0)


def fuzzy(sims: DataFrame, targets: DataFrame, kind: str) -> DataFrame:
    """Files (threshold 0.40, scale 4.5) or symbols (0.45, 5.0, bonus 0.5) whose vector is like the prompt's.

    ``sims``: query, id, sim; ``targets``: id, target, days (since the file changed, or null).
    """
    threshold, scale, bonus = (0.40, 4.5, 0.0) if kind == "file" else (0.45, 5.0, 0.5)
    x = sims.join(targets, "id").withColumn("request_id", F.col("query"))
    s = F.least(F.lit(1.0), F.col("sim") + F.coalesce(stats.recency_bump(F.col("days")), F.lit(0.0)))
    return _rows(x.where(s >= threshold), F.col("target"), kind, (s - threshold) * scale / (1 - threshold) + bonus, F.concat(F.lit("fuzzy:"), F.format_number("sim", 2)))


def doc_intent(sims: DataFrame, intents: DataFrame, threshold: float = 0.42) -> DataFrame:
    """Files and symbols whose stated purpose is like the prompt: the best text of each target counts.

    ``sims``: query, id, sim; ``intents``: id, path, qualname (null: of the file), line_start, source_kind, weight. A symbol
    hands 0.65 of its score to its file.
    """
    x = sims.where(F.col("sim") >= threshold).join(intents, "id").withColumn("request_id", F.col("query"))
    base = (F.col("sim") - threshold) / (1 - threshold) * F.col("weight")
    why = lambda name: F.concat(F.lit(f"{name}:"), F.col("source_kind"), F.lit(":"), F.format_number("sim", 2))
    own = x.where(F.col("qualname").isNull())
    sym = x.where(F.col("qualname").isNotNull())
    rows = _rows(own, F.col("path"), "file", 3.2 * base, why("doc-intent"))
    rows = rows.unionByName(_rows(sym, symbol_target(F.col("qualname"), F.col("path"), F.col("line_start")), "symbol", 3.6 * base, why("doc-intent")))
    rows = rows.unionByName(_rows(sym, F.col("path"), "file", 3.6 * base * 0.65, why("doc-intent-symbol")))
    best = rows.groupBy("request_id", "target", "target_type").agg(F.max(F.struct("score", "reason")).alias("b"))
    return best.select("request_id", "target", "target_type", "b.score", "b.reason")


def context_tokens(history: DataFrame, recent: int = 3) -> DataFrame:
    """id, tokens, expanded: the name tokens of every prompt; prompts that only go on, or have no tokens, take those of the session's ``recent`` prompts before.

    ``history``: session, id, at, prompt. Null sessions have no context.
    """
    own = F.coalesce(text.name_tokens(F.col("prompt")), F.array().cast("array<string>"))
    w = Window.partitionBy("session").orderBy("at", "id")
    rows = history.select("session", "id", "at", "prompt", own.alias("own"))
    before = F.flatten(F.filter(F.array(*[F.lag("own", i).over(w) for i in range(1, recent + 1)]), lambda x: x.isNotNull()))
    rows = rows.withColumn("before", F.when(F.col("session").isNotNull(), before).otherwise(F.array().cast("array<string>")))
    more = (mentions.continues(F.col("prompt")) | (F.size("own") == 0)) & (F.size("before") > 0)
    return rows.select("id", F.when(more, F.array_union("own", "before")).otherwise(F.col("own")).alias("tokens"), more.alias("expanded"))


def lexical(tokens: DataFrame, index: DataFrame, targets: DataFrame, kind: str) -> DataFrame:
    """Files or symbols that share name tokens with the prompt.

    ``tokens``: request_id, tokens, expanded; ``index``: token, id; ``targets``: id, target (for symbols: name, kind). A
    file scores 0.6 + 0.4 a token, at most 1.4; a symbol 0.8 + 0.5 a token, 1.0 more for its whole name, 1.2 for its
    kind, at most 4.0. Tokens from earlier prompts add 0.6.
    """
    from lodespark.operators.lexical import GENERIC_NAMES

    said = tokens.select("request_id", "expanded", F.explode("tokens").alias("token")).distinct()
    asked = said.groupBy("request_id", "expanded").agg(F.collect_set("token").alias("tokens")).toArrow()
    # the tokens of a target stand in one row with all that is told of it, so its pairs with prompts are made there and not moved
    own = index.groupBy("id").agg(F.collect_set("token").alias("own")).join(targets, "id")
    schema = T.StructType([said.schema["request_id"], said.schema["expanded"], *[own.schema[c] for c in targets.columns], T.StructField("n", T.LongType()), T.StructField("words", T.ArrayType(T.StringType()))])
    x = own.select("own", *targets.columns).mapInArrow(_shared_tokens(own.sparkSession.sparkContext.broadcast(asked)), schema)
    bonus = F.when(F.col("expanded"), 0.6).otherwise(0.0)
    why = F.concat(F.when(F.col("expanded"), "lexical-context:").otherwise("lexical:"), F.array_join(F.slice("words", 1, 3), ","))
    if kind == "file":
        return _rows(x, F.col("target"), "file", F.least(1.4 + bonus, 0.6 + 0.4 * F.col("n") + bonus), why)
    x = x.join(F.broadcast(tokens.select("request_id", "tokens").distinct()), "request_id")  # a stated set
    name = F.lower(F.regexp_replace("name", "^_+|_+$", ""))
    exact = F.coalesce(F.array_contains("tokens", name) & ~name.isin(*GENERIC_NAMES), F.lit(False))
    of_kind = F.coalesce(F.array_contains("tokens", F.lower(F.trim("kind"))), F.lit(False))
    score = F.least(4.0 + bonus, 0.8 + 0.5 * F.col("n") + F.when(exact, 1.0).otherwise(0.0) + F.when(of_kind, 1.2).otherwise(0.0) + bonus)
    why = F.concat(why, F.when(exact, "+exact").otherwise(""), F.when(of_kind, "+kind").otherwise(""))
    return _rows(x, F.col("target"), "symbol", score, why)


def _shared_tokens(sent, most: int = 3):
    """Pairs of prompts (request_id, expanded, tokens) and rows (own: tokens, and others) that share tokens: how many (n), and the first ``most`` by name (words)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        lists = asked["tokens"].combine_chunks()
        words = pa.array(sorted(pc.unique(lists.flatten()).to_pylist()), pa.string())
        prompt = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
        token = pc.index_in(lists.flatten(), value_set=words).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(token, kind="stable")
        prompt, first = prompt[order], np.searchsorted(token[order], np.arange(len(words) + 1))
        asked = asked.select(["request_id", "expanded"]).combine_chunks()
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                own = pa.concat_arrays([batch.column(0)])
                which = pc.index_in(own.flatten(), value_set=words)
                hit = np.flatnonzero(which.is_valid().to_numpy(zero_copy_only=False))
                if not len(hit):
                    continue
                row = np.repeat(np.arange(len(own)), np.diff(np.asarray(own.offsets)))[hit]
                which = which.take(pa.array(hit)).to_numpy().astype(np.int64)
                n = first[which + 1] - first[which]
                p = prompt[np.repeat(first[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                row, which = np.repeat(row, n), np.repeat(which, n)
                order = np.lexsort((which, p, row))
                row, p, which = row[order], p[order], which[order]
                start = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (p[1:] != p[:-1])]))
                n = np.diff(np.append(start, len(row)))
                told = np.arange(len(row)) - np.repeat(start, n) < most
                names = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.minimum(n, most))]), pa.int32()), words.take(pa.array(which[told])))
                left, right = pa.array(p[start]), pa.array(row[start])
                columns = [asked[c].combine_chunks().take(left) for c in ("request_id", "expanded")] + [c.take(right) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n.astype(np.int64)), names], names=["request_id", "expanded", *batch.schema.names[1:], "n", "words"])

    return run


def holding(needles: DataFrame, words: DataFrame) -> DataFrame:
    """needle, word: all pairs of a needle and a word that holds it.

    ``needles``: needle; ``words``: word. Needles meet only the words that hold their rarest run of three characters (or the
    whole of shorter ones), so no needle is compared with every word. Empty needles are left out.
    """
    w = words.where(F.col("word").isNotNull()).select("word").distinct()
    runs = lambda c, k: F.when(F.length(c) >= k, F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i: F.substr(c, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    grams = w.select("word", F.explode(F.array_distinct(F.concat(*[runs(F.col("word"), k) for k in (1, 2, 3)]))).alias("gram"))
    n = needles.where(F.length("needle") > 0).select("needle").distinct()
    own = n.select("needle", F.explode(F.when(F.length("needle") <= 3, F.array("needle")).otherwise(F.array_distinct(runs(F.col("needle"), 3)))).alias("gram"))
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    best = own.join(often, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("g")).select("needle", "g.gram")
    return best.join(grams, "gram").where(F.col("word").contains(F.col("needle"))).select("needle", "word")


def literal_files(prompts: DataFrame, files: DataFrame, largest: int = 262_144) -> DataFrame:
    """Files whose text holds literal tokens of the prompt: min(2.5, 1.15 + 0.45 a token).

    ``prompts``: request_id, prompt; ``files``: target, body. Texts above ``largest`` bytes don't count by definition. A
    token stands in a text if it stands in one of its runs of letters, digits and the marks _ . -; the
    distinct runs of all texts are searched once.
    """
    asked = prompts.select("request_id", F.explode(mentions.literal_tokens(F.col("prompt"))).alias("needle")).distinct()
    body = files.where(F.octet_length("body") <= largest)
    runs = body.select("target", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("body"), F.lit(r"[a-z0-9_.-]+"), F.lit(0)))).alias("word"))
    held = holding(asked, runs)
    n = asked.join(held, "needle").join(runs, "word").groupBy("request_id", "target").agg(F.count_distinct("needle").alias("n"), F.array_sort(F.collect_set("needle")).alias("found"))
    return _rows(n, F.col("target"), "file", F.least(F.lit(2.5), 1.15 + 0.45 * F.col("n")), F.concat(F.lit("literal:"), F.array_join(F.slice("found", 1, 3), ",")))


def note_scores(sims: DataFrame, notes: DataFrame, threshold: float = 0.48, scale: float = 3.5) -> DataFrame:
    """Notes like the prompt: (sim - threshold) scale / (1 - threshold). ``sims``: query, id, sim; ``notes``: id, topic."""
    x = sims.where(F.col("sim") >= threshold).join(notes, "id").withColumn("request_id", F.col("query"))
    return _rows(x, F.col("topic"), "finding", (F.col("sim") - threshold) * scale / (1 - threshold), F.concat(F.lit("finding:"), F.format_number("sim", 2)))


def prompt_similarities(prompts: DataFrame, rows: DataFrame, least: float = -2.0) -> DataFrame:
    """query, id, sim of every row (id, vec) with every prompt (request_id, vec), from ``least`` on: a stated query set against all rows."""
    return similarity.similarities(rows, "id", "vec", prompts.select(F.col("request_id").alias("id"), "vec"), least)
