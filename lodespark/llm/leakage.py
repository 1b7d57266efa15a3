"""Evaluation texts leaking into training text: size-partitioned MinHash containment search.

Every evaluation item is cut into all its windows of ``PASSAGE`` words (items shorter than that are
looked up by their words instead), every document into overlapping windows that hold any such passage whole. The shingle sets of the
document windows are partitioned by size; in each partition the containment that a passage with the
allowed changes still has is turned into a Jaccard similarity at the partition's largest size, from which
the number of MinHash bands follows. Document windows that share a band with an item window are candidates.
They are verified by exact containment: some PASSAGE words of the item must have as many of their shingles in the document
as the allowed changes leave. An alignment of the words then tells a passage from shingles that are scattered.
"""

from __future__ import annotations

import hashlib
import html
import math
import pickle
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.session import spread

#: Words of a passage, words of a shingle, changed or added words allowed: one in EDIT_IN.
PASSAGE, SHINGLE, EDIT_IN = 20, 3, 12
#: Document windows: WIDTH words every STRIDE words hold every run of WIDTH - STRIDE words whole.
WIDTH, STRIDE = 36, 12
#: Chance that a passage with the allowed changes shares no band with the document window that holds it.
MISS = 1e-6
#: Items are searched in blocks of so many shingle windows, so what is broadcast is bounded.
BLOCK = 100_000

# Letters of other scripts that look like Latin ones, after lower-casing.
LOOKALIKES = str.maketrans(
    {
        "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ɡ": "g", "һ": "h", "н": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l",
        "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x",
        "у": "y", "ү": "y", "α": "a", "β": "b", "ϲ": "c", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
        "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
        "ꞵ": "b", "ո": "n", "օ": "o", "ս": "u", "ց": "g", "հ": "h", "զ": "q", "ѡ": "w", "ƅ": "b", "ʏ": "y", "ᴏ": "o", "ѐ": "e", "ё": "e", "ї": "i",
    }
)
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\([ntrNTR])|%([0-9a-fA-F]{2})")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--|-->")
_INSIDE = re.compile(r"[_\\*~`'’]+|(?<=\w)-\n(?=\w)")
_WORD = re.compile(r"[^\W_]+")


def _escaped(m: re.Match) -> str:
    code = m[1] or m[2] or m[4]
    return " " if code is None else chr(int(code, 16))


def words_of(text: str | None) -> list[str]:
    """The words of a text without letter case, punctuation, markup, escapes, accents and look-alikes."""
    if not text:
        return []
    if "\\" in text or "%" in text:
        text = _ESCAPE.sub(_escaped, text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if unicodedata.category(c) not in ("Mn", "Cf")).lower().translate(LOOKALIKES)
    return _WORD.findall(_INSIDE.sub("", text.lower()))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(words: list[str], known: dict[str, int]) -> np.ndarray:
    """A 64-bit hash of every run of SHINGLE words."""
    h = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        v = known.get(w)
        if v is None:
            if len(known) > 500_000:
                known.clear()
            v = known[w] = xxhash.xxh64_intdigest(w)
        h[i] = v
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    with np.errstate(over="ignore"):
        for k in range(1, SHINGLE):
            out = _mix(out) + h[k : k + n]
        return _mix(out)


def plan(passage: int = PASSAGE) -> list[tuple[int, int, int]]:
    """Size partitions of the document windows: (smallest, largest, bands) in shingles per window.

    A passage with one word in EDIT_IN changed keeps at least ``kept`` of its ``q`` shingles. In a window
    of at most u shingles that is a Jaccard similarity of kept / (q + u - kept); one-row bands are added
    until the chance of no common band is at most MISS.
    """
    q = passage - SHINGLE + 1
    kept = max(1, q - SHINGLE * (passage // EDIT_IN + 1))
    out, low, top = [], 1, WIDTH - SHINGLE + 1
    while low <= top:
        high = min(top, max(low, low * 2 - 1))
        j = kept / (q + max(high, q) - kept)
        out.append((low, high, math.ceil(math.log(MISS) / math.log(1 - j))))
        low = high + 1
    return out


class Items:
    """Evaluation items, indexed by MinHash bands of their windows."""

    def __init__(self, items: list[tuple[int, str]]):
        self.plan = plan()
        self.bands = max(b for _, _, b in self.plan)
        self.salts = _mix(np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        self.words: list[tuple[int, list[str]]] = [(i, w) for i, t in items if (w := words_of(t))]
        #: items shorter than a passage by words that a document with them holds: the first, or those of one of two halves
        self.short: dict[tuple[str, ...], list[int]] = {}
        keys, which = [], []
        for k, (_, w) in enumerate(self.words):
            if len(w) < PASSAGE:  # at most one edit, which leaves one half as it is
                for a in {0, len(w) // 2 if len(w) >= EDIT_IN else 0}:
                    self.short.setdefault(tuple(w[a : a + SHINGLE]), []).append(k)
                continue
            s = shingles(w, {})
            q = PASSAGE - SHINGLE + 1
            m = np.lib.stride_tricks.sliding_window_view(self.hashed(s), q, axis=1).min(2)  # bands x windows
            for band in range(self.bands):
                u = np.unique(m[band])
                keys.append(_mix(u ^ np.uint64(band)))
                which.append(np.full(len(u), k, np.int64))
        self.keys = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        self.which = np.concatenate(which) if which else np.empty(0, np.int64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.which = self.keys[order], self.which[order]
        # most document keys are absent: a bit table tells them without a search
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.keys & np.uint64((1 << 22) - 1)] = True
        self.at = [_positions(w) for _, w in self.words]
        self.shingled = [shingles(w, {}) for _, w in self.words]

    def hashed(self, s: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix(s[None, :] ^ self.salts[:, None])

    def short_candidates(self, words: list[str]) -> set[int]:
        """Items shorter than a passage that a document's words may hold; none that they hold is missing."""
        found: set[int] = set()
        for n in {len(x) for x in self.short}:
            for x in self.short.keys() & set(zip(*(words[j:] for j in range(n)))):
                found.update(self.short[x])
        return found

    def candidates(self, s: np.ndarray) -> set[int]:
        """Items that share a band with a window of a document's shingles ``s``."""
        found: set[int] = set()
        n, width = len(s), WIDTH - SHINGLE + 1
        if not n or not len(self.keys):
            return found
        starts = np.arange(0, max(1, n - width + STRIDE), STRIDE)
        ends = np.minimum(starts + width, n)
        bands = {b: [] for _, _, b in self.plan}
        for low, high, b in self.plan:
            size = ends - starts
            bands[b].append(np.flatnonzero((size >= low) & (size <= high)))
        for b, rows in bands.items():
            rows = np.concatenate(rows)
            if not len(rows):
                continue
            for lo in range(0, len(rows), 4096):  # bounds the working memory of very long texts
                r = rows[lo : lo + 4096]
                a, z = starts[r], ends[r]
                with np.errstate(over="ignore"):
                    h = _mix(s[None, a[0] : z[-1]] ^ self.salts[:b, None])
                # minima of [a, z) at every second place; an end at the very end needs no index of its own
                base, at_end = a[0], z[-1] - a[0] >= h.shape[1]
                edges = np.stack([a - base, z - base], 1).ravel()[: 2 * len(a) - at_end]
                m = np.minimum.reduceat(h, edges, axis=1)[:, ::2]
                key = _mix(m ^ np.arange(b, dtype=np.uint64)[:, None]).ravel()
                key = np.unique(key[self.bits[key & np.uint64((1 << 22) - 1)]])
                left = np.searchsorted(self.keys, key, "left")
                many = np.searchsorted(self.keys, key, "right") - left
                if many.any():
                    at = np.arange(many.sum()) + np.repeat(left - (np.cumsum(many) - many), many)
                    found.update(np.unique(self.which[at]).tolist())
        return found

    def contained(self, k: int, sorted_shingles: np.ndarray) -> bool:
        """Whether enough shingles of some PASSAGE words of item ``k`` (of the whole of a shorter one) are among a document's.

        Each allowed change or addition of a word takes SHINGLE of them at most, so no passage is refused here.
        """
        own, n = self.shingled[k], len(self.words[k][1])
        edits = PASSAGE // EDIT_IN + 1 if n >= PASSAGE else n // EDIT_IN
        width = min(n, PASSAGE) - SHINGLE + 1
        need = width - SHINGLE * edits
        if need <= 0:
            return True
        if not len(sorted_shingles):
            return False
        at = np.searchsorted(sorted_shingles, own)
        there = sorted_shingles[np.minimum(at, len(sorted_shingles) - 1)] == own
        upto = np.concatenate([[0], np.cumsum(there)])
        return bool((upto[width:] - upto[:-width]).max() >= need)

    def found_in(self, text: str | None, known: dict[str, int]) -> list:
        """The items of which a text holds a passage."""
        words = words_of(text)
        s = shingles(words, known)
        near = sorted(self.candidates(s) | self.short_candidates(words))
        if not near:
            return []
        have = np.unique(s)
        out = []
        for k in near:
            item, own = self.words[k]
            need = min(PASSAGE, len(own))
            if self.contained(k, have) and longest_passage(own, self.at[k], words, need) >= need:
                out.append(item)
        return out


def _positions(words: list[str]) -> dict[str, list[int]]:
    at: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        at.setdefault(w, []).append(i)
    return at


def longest_passage(item: list[str], at: dict[str, list[int]], doc: list[str], need: int) -> int:
    """Words of the longest run of ``item`` in ``doc`` with at most one word in EDIT_IN changed or added.

    Stops at ``need``. Runs of equal words on one diagonal are chained to later runs on the same diagonal (changed words
    between) or on a later one (added words between). A single equal word counts where it is close enough to a
    run of two to be in a chain with it.
    """
    by: dict[int, list[int]] = {}
    for j, w in enumerate(doc):
        for i in at.get(w, ()):
            by.setdefault(j - i, []).append(i)
    runs = []  # first item word, last item word, diagonal
    for d, where in by.items():
        first = prev = where[0]
        for i in where[1:]:
            if i != prev + 1:
                runs.append((first, prev, d))
                first = i
            prev = i
        runs.append((first, prev, d))
    most = max(1, need // EDIT_IN + 1)
    if len(item) >= 4:
        near = set()  # item word, diagonal; between a run and the last of a chain there are `most` edits and single words
        for a, b, d in runs:
            if b > a:
                for i in (*range(a - 2 * most - 1, a), *range(b + 1, b + 2 * most + 2)):
                    near.update((i, d + k) for k in range(-most, most + 1))
        runs = [r for r in runs if r[1] > r[0] or (r[0], r[2]) in near]
    best = max((r[1] - r[0] + 1 for r in runs), default=0)
    if best >= need:
        return best
    runs.sort(key=lambda r: (r[1], r[2]))
    # chains[k]: best (smallest) start for each number of edits, of chains that end with run k
    chains: list[dict[int, int]] = []
    for k, (a, b, d) in enumerate(runs):
        own = {0: a}
        for p in range(k):
            pa_, pb, pd = runs[p]
            if pa_ >= a or d < pd or d - pd > most:
                continue
            begin = max(a, pb + 1)
            if begin > b:
                continue
            gap = begin - pb - 1 + (d - pd)
            if not 0 < gap <= most:
                continue
            for e, start in chains[p].items():
                n = e + gap
                if n <= most and start < own.get(n, 1 << 30):
                    own[n] = start
        chains.append(own)
        for e, start in own.items():
            span = b - start + 1
            if e * EDIT_IN <= span and span > best:
                best = span
    return best


#: Indexes of the blocks that a Python worker has seen last; a worker serves many tasks.
_made: dict[bytes, Items] = {}


def _index(packed: bytes) -> Items:
    key = hashlib.sha1(packed).digest()
    if key not in _made:
        if len(_made) >= 4:
            _made.pop(next(iter(_made)))
        _made[key] = Items(pickle.loads(packed))
    return _made[key]


def _blocks(items: DataFrame, item_col: str, prompt_col: str) -> Iterator[bytes]:
    """The distinct items in blocks of about BLOCK shingle windows; one block at a time is in the driver's memory."""
    rows = items.select(item_col, prompt_col).where(F.col(item_col).isNotNull() & F.col(prompt_col).isNotNull()).distinct()
    block, size = [], 0
    for item, prompt in rows.sort(item_col, prompt_col).toLocalIterator():
        n = len(prompt) // 4
        if block and size + n > BLOCK:
            yield pickle.dumps(block)
            block, size = [], 0
        block.append((item, prompt))
        size += n
    yield pickle.dumps(block)


def leaks(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, prompt_col: str) -> DataFrame:
    """``id_col``, ``item_col``: documents that hold an item, or PASSAGE consecutive words of it.

    Items shorter than PASSAGE words must be there whole, with the same share of edits. Null, empty and wordless texts hold nothing and
    are held nowhere; repeated items and documents count once; null ids are skipped. The items (a stated query
    set) pass through the driver and are sent to the executors in blocks of BLOCK windows; documents are
    read once per block.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    out_type = to_arrow_type(items.schema[item_col].dataType)
    kinds = [docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()]
    schema = f"`{id_col}` {kinds[0]}, `{item_col}` {kinds[1]}"
    rows_of = spread(docs.select(id_col, F.col(text_col).cast("string")).where(F.col(id_col).isNotNull()), id_col)
    out = None
    for block in _blocks(items, item_col, prompt_col):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = _index(sent.value)
            known: dict[str, int] = {}
            for batch in batches:
                a, b = [], []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for item in index.found_in(text, known):
                        a.append(doc)
                        b.append(item)
                yield pa.RecordBatch.from_pydict({id_col: pa.array(a, batch.schema.field(0).type), item_col: pa.array(b, out_type)})

        part = rows_of.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.distinct()
