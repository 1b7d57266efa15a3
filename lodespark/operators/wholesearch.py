"""The fused search of :mod:`search` for many searches over many rows, without pairs of them: executors keep what may be among the first."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodespark.functions import text
from lodespark.operators.search import identifier_of
from lodespark.session import saved

#: Rows and searches whose similarities are computed at once; similarities that differ by less are compared in one fixed order of summation.
ROWS, SEARCHES, NEAR = 2048, 1024, 1e-12


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _owners(lists: pa.Array) -> np.ndarray:
    """The index of the list that each of the flattened values comes from."""
    return np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))


class _Searches:
    """Searches of one vector length, in the order of their identifiers."""

    def __init__(self, t: pa.Table, size: int):
        t = t.sort_by("ident")  # searches without an identifier come last
        ident = t["ident"].combine_chunks()
        self.ids, self.x = t["query"].to_numpy(), _matrix(t["vec"], size)
        self.idents = pc.unique(ident.drop_null())
        self.first = np.searchsorted(pc.index_in(ident, value_set=self.idents).fill_null(len(self.idents)).to_numpy(), np.arange(len(self.idents) + 1))
        lists = t["words"].to_pylist()
        self.words = pa.array(sorted({w for ws in lists for w in ws or ()}), pa.string())
        place = {w: i for i, w in enumerate(self.words.to_pylist())}
        self.of = np.full((len(lists), max([1, *(len(ws or ()) for ws in lists)])), len(place))
        for i, ws in enumerate(lists):
            self.of[i, : len(ws or ())] = [place[w] for w in ws or ()]

    def pairs(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Searches whose identifier is in a row's list, and these rows; by search, each pair once."""
        which = pc.index_in(lists.flatten(), value_set=self.idents)
        hit = np.flatnonzero(which.is_valid().to_numpy(zero_copy_only=False))
        which, row = which.take(pa.array(hit)).to_numpy().astype(np.int64), _owners(lists)[hit]
        n = self.first[which + 1] - self.first[which]
        q = np.repeat(self.first[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        both = np.unique(q * np.int64(len(lists)) + np.repeat(row, n))
        return both // len(lists), both % len(lists)

    def bits(self, words: pa.Array) -> list[np.ndarray]:
        """For the first names of the rows, the second and so on: a row of bits for every word, and one of ones."""
        names, per = _owners(words), words.flatten()
        slot = np.arange(len(names)) - np.searchsorted(names, names)
        which = pc.index_in(per.flatten(), value_set=self.words)
        hit = np.flatnonzero(which.is_valid().to_numpy(zero_copy_only=False))
        which, name, out = which.take(pa.array(hit)).to_numpy(), _owners(per)[hit], []
        for s in range(slot.max() + 1 if len(slot) else 0):
            there = np.zeros((len(self.words) + 1, len(words)), bool)
            mine = slot[name] == s
            there[which[mine], names[name[mine]]] = True
            there[-1] = True
            out.append(np.packbits(there, axis=1))
        return out


def _blocks(batches: Iterable[pa.RecordBatch], known: dict) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        sizes = np.diff(np.asarray(whole.column("vec").offsets))
        for size in np.unique(sizes):
            if int(size) in known:
                part = whole.take(pa.array(np.flatnonzero(sizes == size)))
                for at in range(0, part.num_rows, ROWS):
                    block = part.slice(at, ROWS)
                    block = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in block.columns], names=block.schema.names)
                    yield int(size), block, _matrix(block.column("vec"), int(size))


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same for the same vectors, wherever they stand."""
    return (x * y).sum(1)


def _first(q: np.ndarray, sim: np.ndarray, id_: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are the first ``k`` of their search, in order, and their places from 0."""
    order = np.lexsort((id_, -sim, q))
    place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
    return order[place < k], place[place < k]


def _kept(sent, k: int):
    """query, tier, id, sim of the first ``k`` rows of these batches for each search, of all tiers and of each tier from 1 on. Tier -1 counts the rows of tier 2 (sim)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, best, floor, twos = sent.value, {}, {}, {}
        for size, block, x in _blocks(batches, known):
            s, ids, rows = known[size], block.column("id").to_numpy(), block.num_rows
            three, two, bits = s.pairs(block.column("names")), s.pairs(block.column("tails")), s.bits(block.column("words"))
            limits = floor.setdefault(size, np.full((4, len(s.ids)), -np.inf))
            count = twos.setdefault(size, np.zeros(len(s.ids), np.int64))
            for lo in range(0, len(s.ids), SEARCHES):
                hi = min(lo + SEARCHES, len(s.ids))
                of, sims = s.of[lo:hi], s.x[lo:hi] @ x.T
                held = np.zeros((hi - lo, (rows + 7) // 8), np.uint8)
                for b in bits:
                    own = b[of[:, 0]]
                    for c in range(1, of.shape[1]):
                        own &= b[of[:, c]]
                    held |= own
                held[of[:, 0] == len(s.words)] = 0
                tier = np.unpackbits(held, axis=1, count=rows)
                for n, (q, r) in ((2, two), (3, three)):
                    a, z = np.searchsorted(q, (lo, hi))
                    tier[q[a:z] - lo, r[a:z]] = n
                a, z = np.searchsorted(two[0], (lo, hi))
                count[lo:hi] += np.bincount(two[0][a:z] - lo, weights=tier[two[0][a:z] - lo, two[1][a:z]] == 2, minlength=hi - lo).astype(np.int64)
                least = limits[0, lo:hi]
                if rows > k and np.isinf(least).any():
                    least = np.maximum(least, np.partition(sims, rows - k, axis=1)[:, rows - k])
                new = {0: np.flatnonzero(sims >= (least - NEAR)[:, None])}
                some = np.flatnonzero(tier)
                kind = tier.ravel()[some]
                fine = sims.ravel()[some] >= limits[kind, some // rows + lo] - NEAR
                new |= {n: some[fine & (kind == n)] for n in (1, 2, 3)}
                for n, at in new.items():
                    if len(at):
                        q, r = at // rows + lo, at % rows
                        now = (q, _exact(s.x[q], x[r]), ids[r], tier.ravel()[at])
                        if (size, lo, n) in best:
                            now = tuple(np.concatenate(p) for p in zip(best[size, lo, n], now))
                        chosen, place = _first(now[0], now[1], now[2], k)
                        best[size, lo, n] = now = tuple(c[chosen] for c in now)
                        last = place == k - 1
                        limits[n, now[0][last]] = now[1][last]
        for (size, _, n), (q, sim, id_, tier) in best.items():
            use = tier == n  # what is first of all tiers is among the first of its own
            if n != 3:
                use &= np.isinf(floor[size][3, q])  # with ``k`` exact names nothing else counts
            yield _rows(known[size].ids[q[use]], tier[use], id_[use], sim[use])
        for size, n in twos.items():
            some = np.flatnonzero(n)
            yield _rows(known[size].ids[some], np.full(len(some), -1), np.zeros(len(some)), n[some])

    return run


def _rows(query, tier, id_, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(tier.astype(np.int32)), pa.array(id_.astype(np.int64)), pa.array(sim.astype(np.float64))], names=["query", "tier", "id", "sim"])


def _before(sent):
    """query, id, n: how many of these batches' rows come before a search's row by similarity, then id."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = sent.value, {}
        for size, block, x in _blocks(batches, known):
            ids, vec, _, sim, id_ = block.column("id").to_numpy(), *known[size]
            n = counts.setdefault(size, np.zeros(sim.shape, np.int64))
            for lo in range(0, len(vec), SEARCHES):
                sims = vec[lo : lo + SEARCHES] @ x.T
                for c in range(sim.shape[1]):
                    m = int(np.isfinite(sim[lo : lo + SEARCHES, c]).sum())  # searches with more rows come first
                    if not m:
                        break
                    at, some = sim[lo : lo + m, c][:, None], sims[:m]
                    more, upto = np.count_nonzero(some > at + NEAR, axis=1), np.count_nonzero(some >= at - NEAR, axis=1)
                    n[lo : lo + m, c] += more
                    for q in np.flatnonzero(upto > more):
                        r = np.flatnonzero(np.abs(some[q] - at[q]) <= NEAR)
                        own = _exact(x[r], vec[lo + q][None, :])
                        n[lo + q, c] += int(((own > at[q]) | ((own == at[q]) & (ids[r] < id_[lo + q, c]))).sum())
        for size, n in counts.items():
            _, asked, sim, id_ = known[size]
            q, c = np.nonzero(np.isfinite(sim))
            yield pa.RecordBatch.from_arrays([pa.array(asked[q], pa.int64()), pa.array(id_[q, c]), pa.array(n[q, c])], names=["query", "id", "n"])

    return run


def search(asked: DataFrame, rows: DataFrame, k: int, damping: int = 60) -> DataFrame:
    """query, id, sim, tier, place: what :func:`search.search` gives of all similarities of ``asked`` (query, text, vec) and ``rows`` (id, names, vec; each id once, numbers).

    All rows are compared with all searches where the rows are, and what leaves an executor are the first ``k`` of each tier: of rows of one tier, one that is less alike
    comes later, and a row of no tier that is not among the first ``k`` by similarity has ``k`` before it. The place by similarity of the few
    that remain is counted in a second pass over all rows. Searches (a stated set) are sent to the executors.
    """
    spark = rows.sparkSession
    v = F.col("vec")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    low = F.transform("names", lambda n: F.lower(n))
    parts = lambda n: F.split(n, r"\.")
    tails = lambda n: F.when(F.size(parts(n)) > 1, F.transform(F.sequence(F.lit(2), F.size(parts(n))), lambda i: F.array_join(F.slice(parts(n), i, 10000), "."))).otherwise(F.array().cast("array<string>"))
    cores = spark.sparkContext.defaultParallelism
    kept = rows.where(F.col("id").isNotNull() & fine).select("id", v, F.filter("names", lambda n: F.length(n) > 0).alias("names")).repartition(3 * cores, "id").distinct()
    r = kept.select("id", "vec", low.alias("names"), F.flatten(F.transform(low, tails)).alias("tails"), F.transform("names", text.search_tokens).alias("words"))
    ident = identifier_of(F.col("text"))
    q = asked.where(F.col("query").isNotNull() & fine).select("query", "vec", F.lower(ident).alias("ident"), text.search_tokens(ident).alias("words")).distinct().toArrow()
    sizes = pc.list_value_length(q["vec"])
    known = {d: _Searches(q.filter(pc.equal(sizes, d)), d) for d in pc.unique(sizes).to_pylist()}
    sent = spark.sparkContext.broadcast(known)
    found = r.mapInArrow(_kept(sent, k), "query bigint, tier int, id bigint, sim double").repartition("query")  # the only time that these rows are moved
    x = found.groupBy("query", "tier", "id", "sim").agg(F.count("*").alias("times"))
    x = x.withColumn("two", F.sum(F.when(F.col("tier") < 0, F.col("sim") * F.col("times"))).over(Window.partitionBy("query")).cast("bigint")).drop("times").where(F.col("tier") >= 0)
    by = Window.partitionBy("query", "tier").orderBy(F.col("sim").desc(), "id")
    x = x.withColumn("p", F.row_number().over(by)).where(F.col("p") <= k)
    x = x.withColumn("u", F.row_number().over(Window.partitionBy("query").orderBy(F.col("sim").desc(), "id"))).withColumn("exact", F.count_if(F.col("tier") == 3).over(Window.partitionBy("query")))
    x = saved(x.where((F.col("tier") == 3) | ((F.col("exact") < k) & (F.col("p") <= k - F.col("exact")) & ((F.col("tier") > 0) | (F.col("u") <= k)))), "first")
    open_ = x.where(F.col("tier").between(1, 2) & (F.col("u") > k)).select("query", "id", "sim").toArrow()
    sent = spark.sparkContext.broadcast(_thresholds(known, open_))
    n = kept.select("id", "vec").mapInArrow(_before(sent), "query bigint, id bigint, n bigint").groupBy("query", "id").agg((F.sum("n") + 1).alias("i"))
    x = x.join(n, ["query", "id"], "left").withColumn("i", F.coalesce("i", "u"))
    j = F.when(F.col("tier") == 2, F.col("p")).when(F.col("tier") == 1, F.col("p") + F.coalesce("two", F.lit(0)))
    rrf = 1.0 / (damping + F.col("i")) + F.coalesce(1.0 / (damping + j), F.lit(0.0))
    order = Window.partitionBy("query").orderBy((F.col("tier") == 3).desc(), F.when(F.col("tier") == 3, -F.col("p").cast("double")).otherwise(rrf).desc(), "i")
    return x.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query", "id", "sim", "tier", "place")


def _thresholds(known: dict, rows: pa.Table) -> dict:
    """By vector length: vectors, numbers, similarities and ids of the searches that have rows to be counted; those with most rows first."""
    out = {}
    query, id_, sim = (rows[c].to_numpy() for c in ("query", "id", "sim"))
    for size, s in known.items():
        order = np.argsort(s.ids)
        at = np.minimum(np.searchsorted(s.ids[order], query), len(s.ids) - 1)
        mine = np.flatnonzero(s.ids[order][at] == query)
        if not len(mine):
            continue
        own, which, n = np.unique(order[at[mine]], return_inverse=True, return_counts=True)
        rank = np.empty(len(own), np.int64)
        rank[np.argsort(-n, kind="stable")] = np.arange(len(own))
        by = np.argsort(rank[which], kind="stable")
        row = rank[which][by]
        column = np.arange(len(row)) - np.searchsorted(row, row)
        sims, ids = np.full((len(own), n.max()), np.inf), np.zeros((len(own), n.max()), np.int64)
        sims[row, column], ids[row, column] = sim[mine][by], id_[mine][by]
        names = own[np.argsort(rank)]
        out[size] = (s.x[names], s.ids[names], sims, ids)
    return out
