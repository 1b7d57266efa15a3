"""Most similar vectors of every vector with a permutation index.

Pivots are vectors of the collection. Every vector is posted in the inverted files of its nearest pivots. A
file with more than LEAF members is indexed again with pivots from its own members, so dense regions,
which distant pivots can't order, get local ones. Inside a file every vector is represented by the order in
which it sees LOCAL pivots of that file; its members are ranked by the footrule distance of these orders,
and the best ``spread * k`` of each vector are reranked by the exact cosine. A file thus tells at most k pairs a member,
whatever its density. Files that no pivots can part are cut into chunks, and each pair of chunks becomes a
task of its own. Exact copies are one vector of the index.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodespark.session import saved

#: Members of a file on average, most members of a file that one task compares, and levels of the index.
FILE, LEAF, LEVELS = 1024, 4096, 6
#: Most pivots of the first level; each is one vector sent to every executor.
MOST_PIVOTS = 2048
#: Members of a large file that one task posts anew.
POSTED_AT_ONCE = 1 << 16
#: Pivots of a file that order its members, and the shares of them at which ranks are told apart.
LOCAL, STEPS = 256, (0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875)
#: Rows of a file that are compared with the whole file at once.
ROWS = 256


def usable(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """``id``, ``v`` of the vectors with exactly ``dim`` finite values that are not all zero. Null ids are dropped."""
    v = F.col(vec_col)
    fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return df.where(F.col(id_col).isNotNull() & v.isNotNull() & fine).select(F.col(id_col).cast("bigint").alias("id"), v.cast("array<float>").alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Normalised float32 rows of a list column."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    flat /= np.abs(flat).max(1, keepdims=True)
    return (flat / np.sqrt((flat * flat).sum(1, keepdims=True))).astype(np.float32)


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    at = column.offset
    offsets = np.frombuffer(column.buffers()[1], np.int32)[at : at + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.empty(0, np.uint8)
    return data.view(np.float32).reshape(len(column), dim)


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def _normalised(dim: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for batch in _slices(whole, 4096):
                x = _matrix(batch.column(1), dim)
                q = np.round(x, 6) + np.float32(0)  # no negative zeros
                keys = np.array([xxhash.xxh64_intdigest(r.tobytes()) for r in q], np.uint64).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), _binary(x)], names=["id", "key", "vec"])

    return run


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, posts: int) -> np.ndarray:
    """The ``posts`` nearest pivots of every row, in no order; all pivots if there are no more."""
    if posts >= len(pivots):
        return np.tile(np.arange(len(pivots)), (len(x), 1))
    return np.argpartition(-(x @ pivots.T), posts - 1, axis=1)[:, :posts]


def _posted(ids: pa.Array, x: np.ndarray, group: int, pivots: np.ndarray, posts: int, with_vector: bool) -> pa.RecordBatch:
    near = nearest_pivots(x, pivots, posts)
    file = (_mixed(near.astype(np.uint64)) ^ _mixed(np.array([group], np.int64).view(np.uint64))).view(np.int64)
    columns = [pa.array(file.ravel()), pa.array(np.repeat(ids.to_numpy(), near.shape[1]))]
    if with_vector:
        columns.append(_binary(np.repeat(x, near.shape[1], axis=0)))
    return pa.RecordBatch.from_arrays(columns, names=["file", "id", "vec"][: len(columns)])


def _post(dim: int, posts: int, sent, with_vector: bool):
    """First level: posts every vector in the files of its nearest pivots."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = np.frombuffer(sent.value, np.float32).reshape(-1, dim)
        for whole in batches:
            for batch in _slices(whole, 2048):
                yield _posted(batch.column(0), _rows(batch.column(1), dim), 0, pivots, posts, with_vector)

    return run


def _post_again(dim: int, posts: int):
    """Deeper levels: rows (file, salt, kind, id, vec) sorted so that a file's own pivots (kind 0) precede its members."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, pivots = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            file, salt, kind = (batch.column(i).to_numpy() for i in range(3))
            edge = np.flatnonzero((file[1:] != file[:-1]) | (salt[1:] != salt[:-1]) | (kind[1:] != kind[:-1])) + 1
            for s, e in zip([0, *edge.tolist()], [*edge.tolist(), len(file)]):
                if (file[s], salt[s]) != here:
                    here, pivots = (file[s], salt[s]), []
                if kind[s] == 0:
                    pivots.append(_rows(batch.column(4).slice(s, e - s), dim))
                    continue
                for part in _slices(batch.slice(s, e - s), 2048):
                    if pivots:
                        yield _posted(part.column(3), _rows(part.column(4), dim), int(file[s]), np.concatenate(pivots), posts, True)
                    else:
                        yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), part.column(4)], names=["file", "id", "vec"])

    return run


def rank_codes(x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The order in which every row sees the file's local pivots: for each of STEPS, 1 for the pivots that are among its nearest share.

    The number of places in which two codes differ is the footrule distance of the two orders, with ranks told
    apart in steps of an eighth of the pivots.
    """
    n = min(LOCAL, len(x))
    pivots = x[np.argsort(_mixed(ids), kind="stable")[:n]]
    s = x @ pivots.T - (pivots * pivots).sum(1) / 2  # by distance: the rows need not be normalised
    places = [min(n - 1, max(0, n - round(c * n))) for c in STEPS]
    least = np.partition(s, sorted(set(places)), axis=1)[:, places]
    return np.concatenate([s >= least[:, [i]] for i in range(len(places))], 1).astype(np.float32)


def footrule(codes: np.ndarray) -> np.ndarray:
    """Footrule distances of all rows to each other; the places that differ are counted by a product of the 0-1 codes."""
    n = len(codes)
    ones = codes.sum(1)
    out = np.empty((n, n), np.int16)
    for lo in range(0, n, ROWS):
        hi = min(n, lo + ROWS)
        d = (ones[lo:hi, None] + ones[lo:] - 2 * (codes[lo:hi] @ codes[lo:].T)).astype(np.int16)
        out[lo:hi, lo:] = d
        out[lo:, lo:hi] = d.T
    return out


def best_in_file(x: np.ndarray, ids: np.ndarray, k: int, spread: int, min_cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, partner, cosine): of the ``spread * k`` nearest of each row by footrule (with ties), both ways, the k of the highest cosine (with ties)."""
    n, many = len(x), spread * k
    near = None
    y = x - x.mean(0)  # of unit vectors 1 - cosine is half the squared distance, which is precise in tight files only without their mean
    half = (y * y).sum(1) / 2
    if n - 1 > many:
        d = footrule(rank_codes(y, ids))
        np.fill_diagonal(d, np.iinfo(np.int16).max)
        near = d <= np.partition(d, many - 1, axis=1)[:, [many - 1]]
        near |= near.T
    left, right = [], []
    for lo in range(0, n, ROWS):
        s = y[lo : lo + ROWS] @ y.T - half - half[lo : lo + ROWS, None]  # cosine - 1
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -4
        good = s >= max(min_cosine - 1e-4, -1.5) - 1
        if near is not None:
            good &= near[lo : lo + ROWS]
        full = np.flatnonzero(good.sum(1) > k)
        if len(full):
            t = np.where(good[full], s[full], np.float32(-4))
            good[full] &= t >= np.partition(t, n - k, axis=1)[:, [n - k]]
        a, b = np.nonzero(good)
        left.append(lo + a)
        right.append(b)
    a, b = np.concatenate(left), np.concatenate(right)
    apart = x[a].astype(np.float64) - x[b]
    cosine = 1 - np.einsum("ij,ij->i", apart, apart) / 2
    good = cosine >= min_cosine
    return a[good], b[good], cosine[good]


def _compare(dim: int, k: int, spread: int, min_cosine: float):
    """The best partners of every member within each file; rows (file, task, id, vec) sorted by file and task."""

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        file, task, ids = (t.column(c).to_numpy() for c in ("file", "task", "id"))
        x = _rows(t.column("vec").chunk(0), dim)
        edge = (np.flatnonzero((file[1:] != file[:-1]) | (task[1:] != task[:-1])) + 1).tolist()
        for s, e in zip([0, *edge], [*edge, len(file)]):
            if e - s > 1:
                a, b, c = best_in_file(x[s:e], ids[s:e], k, spread, min_cosine)
                yield pa.RecordBatch.from_arrays([pa.array(ids[s + a]), pa.array(ids[s + b]), pa.array(c)], names=["a", "b", "cosine"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the file that may go on in the next batch
        here = None
        for batch in batches:
            if not batch.num_rows:
                continue
            file, task = (batch.column(i).to_numpy() for i in (0, 1))
            last = np.flatnonzero((file != file[-1]) | (task != task[-1]))
            begin = int(last[-1]) + 1 if len(last) else 0
            if begin or here not in (None, (file[0], task[0])):
                ready = [*held, batch.slice(0, begin)]
                yield from work(pa.Table.from_batches(ready))
                held = []
            held.append(batch.slice(begin))
            here = (file[-1], task[-1])
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


def _files(reps: DataFrame, n: int, dim: int, posts: int) -> DataFrame:
    """(file, task, id, vec): the members of all files, none larger than a task can compare."""
    spark = reps.sparkSession
    vectors = reps.select("id", "vec")
    if n <= LEAF:
        return vectors.select(F.lit(0).cast("bigint").alias("file"), F.lit(0).cast("bigint").alias("task"), "id", "vec")
    size = min(MOST_PIVOTS, math.ceil(n * posts / FILE))
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(size).select("vec").collect()
    sent = spark.sparkContext.broadcast(b"".join(bytes(r[0]) for r in sample))
    sizes = vectors.mapInArrow(_post(dim, posts, sent, False), "file bigint, id bigint").groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    rows = vectors.mapInArrow(_post(dim, posts, sent, True), "file bigint, id bigint, vec binary")
    done = []
    for level in range(1, LEVELS):
        large = saved(sizes.where(F.col("n") > LEAF), "large")
        if large.isEmpty():
            return _united([*done, rows.withColumn("task", F.lit(0).cast("bigint"))])
        done.append(rows.join(large, "file", "left_anti").withColumn("task", F.lit(0).cast("bigint")))
        members = rows.join(large, "file").withColumn("salts", F.ceil(F.col("n") / POSTED_AT_ONCE))
        # about posts / FILE of the members, MOST_PIVOTS at most in expectation
        share = F.least(F.lit(posts / FILE), MOST_PIVOTS / F.col("n"))
        own = members.where(F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 30)) < share * (1 << 30))
        own = own.select("file", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "id", "vec")
        members = members.select("file", F.pmod(F.xxhash64("id", F.lit(0)), F.col("salts")).alias("salt"), F.lit(1).alias("kind"), "id", "vec")
        both = own.unionByName(members).repartition("file", "salt").sortWithinPartitions("file", "salt", "kind")
        rows = saved(both.mapInArrow(_post_again(dim, posts), "file bigint, id bigint, vec binary"), f"files{level}")
        sizes = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    # what no pivots part: every pair of chunks is a task
    large = saved(sizes.where(F.col("n") > LEAF).select("file", F.ceil(2 * F.col("n") / LEAF).alias("chunks")), "large")
    if large.isEmpty():
        return _united([*done, rows.withColumn("task", F.lit(0).cast("bigint"))])
    done.append(rows.join(large, "file", "left_anti").withColumn("task", F.lit(0).cast("bigint")))
    cut_up = rows.join(large, "file").withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")))
    cut_up = cut_up.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    done.append(cut_up.select("file", "id", "vec", (F.shiftleft(F.least("own", "other"), 31) + F.greatest("own", "other")).alias("task")))
    return _united(done)


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("file", "task", "id", "vec")


def posts_for(min_cosine: float) -> int:
    """Files a vector is posted in: near partners share a nearest pivot more often than distant ones."""
    return 5 if min_cosine >= 0.8 else 12


def similar_pairs(df: DataFrame, id_col: str, vec_col: str, dim: int = 64, k: int = 5, min_cosine: float = 0.9, posts: int | None = None, spread: int = 32) -> DataFrame:
    """Pairs ``id_a`` < ``id_b`` with a cosine of at least ``min_cosine`` of which one is among the ``k`` nearest of the other.

    Ties in similarity go to the smaller id. ``posts`` inverted files hold each vector (:func:`posts_for`
    by default), and the nearest ``spread * k`` by footrule in each are reranked; the index is approximate,
    every vector is indexed and searched. Copies have cosine 1 and are each other's nearest. Unusable
    vectors (see :func:`usable`) and empty input give no rows. ids must be integers.
    """
    spark = df.sparkSession
    rows = usable(df, id_col, vec_col, dim).mapInArrow(_normalised(dim), "id bigint, key bigint, vec binary")
    # vectors move once, by their key; an id that came with several vectors belongs to the lowest key
    members = rows.groupBy("id").agg(F.min("key").alias("key"))
    classes = members.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    reps = saved(rows.groupBy("key").agg(F.min("vec").alias("vec")).join(classes, "key"), "vectors")
    n, copies = reps.agg(F.count(F.lit(1)), F.max("copies")).first()
    if not n:
        return spark.createDataFrame([], "id_a bigint, id_b bigint, cosine double")
    if n > 1:
        tasks = _files(reps, n, dim, posts or posts_for(min_cosine)).repartition("file", "task").sortWithinPartitions("file", "task")
        near = tasks.mapInArrow(_compare(dim, k, spread, min_cosine), "a bigint, b bigint, cosine double")
        both = near.repartition("a").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    else:
        both = spark.createDataFrame([], "a bigint, b bigint, cosine double")
    if copies > 1:
        # of a class of copies the k + 1 smallest ids can be someone's neighbours; each member has its own list
        many = reps.where("copies > 1").select("id")
        member = members.join(reps.where("copies > 1").select("key", F.col("id").alias("rep")), "key").select("id", "rep")
        heads = member.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1).drop("r")
        heads = heads.unionByName(reps.where("copies = 1").select("id", F.col("id").alias("rep")))
        every = member.unionByName(reps.where("copies = 1").select("id", F.col("id").alias("rep")))
        links = both.unionByName(many.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("cosine")))
        to = links.join(heads.select(F.col("id").alias("to"), F.col("rep").alias("b")), "b").select("a", "to", "cosine")
        best = to.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.col("cosine").desc(), "to"))).where(F.col("r") <= k + 1)
        both = every.select("id", F.col("rep").alias("a")).join(best.drop("r"), "a").where(F.col("id") != F.col("to")).select(F.col("id").alias("a"), F.col("to").alias("b"), "cosine")
    w = Window.partitionBy("a").orderBy(F.col("cosine").desc(), "b")
    top = both.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return top.groupBy(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).agg(F.max("cosine").alias("cosine"))
