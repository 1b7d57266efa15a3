"""Encoding of a corpus with a public byte-level BPE vocabulary by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token that can end its encoding. These last tokens are
stored; the encoding is read off backwards. A prefix's last token depends only on earlier ones, so bytes
can be appended without encoding anything again, and after an edit the stored tokens are kept up to the
edit and taken over again as soon as they agree for the length of the longest token.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.session import spread

# Fixed value: the pattern that cuts text into pieces before the vocabulary applies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NEVER = 1 << 60


def default_vocabulary() -> str:
    """Path of the installed byte_bpe_50k vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class PrefixBpe:
    """A vocabulary of byte strings with ranks (= ids), ready for prefix encoding."""

    def __init__(self, vocabulary: bytes):
        """``vocabulary``: lines of base64 token and rank; all 256 single bytes must be there."""
        self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
        self.longest = max(map(len, self.ids))
        self.tokens = {i: t for t, i in self.ids.items()}
        # right_chain[t]: t, its right half, that one's right half ... each with the rank at which it is swallowed
        self.right_chain: dict[int, tuple] = {}
        self.left_chain: dict[int, tuple] = {}
        self.merged: dict[tuple[int, int], int] = {}
        ends: dict[bytes, set[int]] = {}
        for i in sorted(self.tokens):
            t = self.tokens[i]
            ends.setdefault(t[-2:], set()).add(len(t))
            self.right_chain[i] = self.left_chain[i] = ((i, NEVER),)
            for cut in range(len(t) - 1, 0, -1):
                a, b = self.ids.get(t[:cut]), self.ids.get(t[cut:])
                if a is not None and b is not None and a < i and b < i and self.stable(a, b):
                    self.merged[a, b] = i
                    self.right_chain[i] = ((i, NEVER), (b, i), *self.right_chain[b][1:])
                    self.left_chain[i] = ((i, NEVER), (a, i), *self.left_chain[a][1:])
                    break
        self.ends = {k: tuple(sorted(v | {1}, reverse=True)) for k, v in ends.items()}
        for one in range(256):
            if (k := bytes([one])) not in self.ids:
                raise ValueError("a byte is missing in the vocabulary")
            self.ends.setdefault(k, (1,))
        self.split = regex.compile(PIECES).findall
        self.known: dict[str, tuple] = {}
        self.checked: dict[tuple[int, int], bool] = {}

    def stable(self, a: int, b: int) -> bool:
        """Whether tokens ``a`` and ``b`` stay as they are side by side.

        They don't if, at some rank, the edge parts that a and b then consist of merge across the border.
        At equal ranks the leftmost merge comes first.
        """
        for x, gone in self.right_chain[a]:
            for y, taken in self.left_chain[b]:
                c = self.merged.get((x, y))
                if c is not None and c < gone and c <= taken:
                    return False
        return True

    def extend(self, last: list[int], data: bytes, upto: int | None = None) -> None:
        """Store the last token of every further prefix of ``data``; ``last`` holds those of the first ones."""
        ids, ends, checked = self.ids, self.ends, self.checked
        for i in range(len(last) + 1, (len(data) if upto is None else upto) + 1):
            for n in ends.get(data[max(0, i - 2) : i]) or ends[data[i - 1 : i]]:
                j = i - n
                if j < 0:
                    continue
                t = ids.get(data[j:i])
                if t is None:
                    continue
                if j == 0:
                    last.append(t)
                    break
                pair = (last[j - 1], t)
                ok = checked.get(pair)
                if ok is None:
                    if len(checked) > 500_000:
                        checked.clear()
                    ok = checked[pair] = self.stable(*pair)
                if ok:
                    last.append(t)
                    break

    def read(self, last: list[int]) -> list[int]:
        """The encoding that the stored last tokens stand for."""
        out, i = [], len(last)
        while i:
            out.append(last[i - 1])
            i -= len(self.tokens[last[i - 1]])
        return out[::-1]

    def edit(self, last: list[int], old: bytes, start: int, end: int, new: bytes) -> tuple[list[int], bytes]:
        """Stored tokens and bytes after ``old[start:end]`` became ``new``, computed near the edit only."""
        data = old[:start] + new + old[end:]
        kept, shift, settled = last[:start], len(new) - (end - start), 0
        while len(kept) < len(data):
            self.extend(kept, data, len(kept) + 1)
            at = len(kept) - shift
            # past the edit and with the same last token as before?
            same = at > end and kept[-1] == last[at - 1]
            settled = settled + 1 if same else 0
            if settled > self.longest:
                return kept + last[at:], data
        return kept, data

    def piece(self, text: str) -> tuple[int, ...]:
        last: list[int] = []
        data = text.encode("utf-8", "surrogatepass")
        self.extend(last, data)
        return tuple(self.read(last))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty text give the empty list."""
        out: list[int] = []
        if not text:
            return out
        known = self.known
        for p in self.split(text):
            ids = known.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(p) <= 64:
                    if len(known) > 300_000:
                        known.clear()
                    known[p] = ids
            out += ids
        return out


_made: dict[bytes, PrefixBpe] = {}


def encode_texts(df: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None) -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of every row, without special tokens.

    Null and empty texts give the empty list; blank texts and texts that look like special tokens are
    ordinary text; null ids and repeated rows stay. ``vocabulary``: path of the token file, read on the
    driver and sent to the executors (its size doesn't depend on the corpus).
    """
    with open(vocabulary or default_vocabulary(), "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hashlib.sha1(sent.value).digest()
        bpe = _made.get(key) or _made.setdefault(key, PrefixBpe(sent.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids = pa.array([bpe.encode(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return spread(df.select(id_col, F.col(text_col).cast("string")), id_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
