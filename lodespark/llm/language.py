"""Missing or wrong document language labels: a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of labelled documents;
it gives every byte of a sentence a distribution over the languages, which is pooled over the sentence.
Sentences of a document are then labelled together, with a cost for each change of language, so mixed
documents fall into segments with a language and a confidence.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import unicodedata
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodespark.session import spread

#: The training sample: documents per language and characters of each.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 4000
#: Labels of this share of the labelled documents are learnt as they are. A rarer label is learnt if it has LEAST_DOCS
#: documents and no more than KNOWN of their words occur under the common labels: else it is a wrong label of theirs.
COMMON_SHARE, LEAST_DOCS, KNOWN = 0.005, 4, 0.6
#: The network: hidden units a direction; training windows in bytes, windows a batch, batches before and after cleaning.
HIDDEN, WINDOW, BATCH, FIRST, SECOND = 32, 48, 128, 180, 400
#: Bytes of one stretch that inference runs over; longer sentences are cut in several.
STRETCH = 256
#: Cost of a change of language between sentences, in nats; least sentences of a language beside others.
CHANGE, LEAST_SENTENCES = 2.0, 2

# ISO 639 codes and English names.
LANGUAGES = """
en eng english|de deu ger german|es spa spanish castilian|fr fra fre french|pt por portuguese|it ita italian|nl nld dut dutch flemish|ru rus russian
ja jpn japanese|zh zho chi chinese mandarin|ko kor korean|ar ara arabic|pl pol polish|tr tur turkish|sv swe swedish|da dan danish|no nor norwegian
nb nob|nn nno|fi fin finnish|cs ces cze czech|sk slk slo slovak|hu hun hungarian|ro ron rum romanian|bg bul bulgarian|uk ukr ukrainian
el ell gre greek|he heb hebrew|hi hin hindi|id ind indonesian|ms msa may malay|vi vie vietnamese|th tha thai|fa fas per persian|ca cat catalan
hr hrv croatian|sr srp serbian|sl slv slovenian|et est estonian|lv lav latvian|lt lit lithuanian|ga gle irish|eu eus baq basque|gl glg galician
""".strip()  # fmt: skip
# All two-letter codes of ISO 639.
CODES = (
    "aa ab ae af ak am an ar as av ay az ba be bg bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy "
    "ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv "
    "mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw "
    "ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu"
).split()
_CODES = {c: c for c in CODES} | {w: line.split()[0] for row in LANGUAGES.split("\n") for line in row.split("|") for w in line.split()}

_FENCE = re.compile(r"^[ \t]*(```|~~~)[^\n]*\n.*?(?:^[ \t]*\1[ \t]*$|\Z)", re.M | re.S)
_INLINE = re.compile(r"(?<!`)`[^`\n]+`(?!`)")
_LOG = re.compile(r"^\s*\[?\d{4}-\d\d-\d\d[ T]\d\d:\d\d[^\n]*$|^\s*(?:\[?(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\]?)\b[^\n]*$", re.M)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|&#?\w+;")
_LEAD = re.compile(r"^[\s>*•|/\-+]+|^\d+[.)]\s+")
_NOT_PROSE = re.compile(r"[!-~]{30,}|[!-~]*(?:[A-Za-z][/\\.:@=][A-Za-z]|[\d_])[!-~]*|[A-Za-z]*[a-z][A-Z][A-Za-z]*|\b[A-Z]{2,}\b")
_EDGE = ".,;:!?…()[]{}\"'«»“”„‘’`*<>|~=+-–—#。、，！？（）「」：；¿¡"
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'»”)\]]*\s+|(?<=[。！？])")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def language_code(label: Column) -> Column:
    """The two-letter code that a label stands for in any letter case, as long name, three-letter code or with a region; else null."""
    base = F.regexp_extract(F.lower(F.trim(F.regexp_replace(label, r"[\s ]+", " "))), r"^([a-z]+)", 1)
    table = F.create_map(*[F.lit(x) for kv in _CODES.items() for x in kv])
    return F.try_element_at(table, base)


def repaired(text: str) -> str:
    """Text whose UTF-8 bytes were read as Latin-1 or Windows-1252, read rightly; other text as it is."""
    if not re.search("[ÂÃÐÑãåæçèéäïà-ø][\u0080-\u00bf‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]", text):
        return text

    def one(m: re.Match) -> str:
        raw = b"".join(c.encode("cp1252") if c in _CP1252 else c.encode("latin-1") for c in m[0])
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    return re.sub("[\u0080-\u00ff‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ€]{2,}", one, text)


_CP1252 = frozenset("‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ€")


def words_in(s: str) -> list[str]:
    """The words of natural language in a sentence: no identifiers, numbers, acronyms, paths or encoded data."""
    out = []
    for token in s.split():
        word = token if token.isalpha() else token.strip(_EDGE)
        if word.isalpha() and len(word) < 30:
            if word[1:].islower() or len(word) == 1 or word[0] > "\u02ff" and not word.isascii():
                out.append(word)
        elif word:
            out += _WORD.findall(_NOT_PROSE.sub(" ", word))
    return out


def sentences(text: str | None) -> list[str]:
    """The sentences of a text's prose, reduced to their words; code, identifiers, logs and encoded data are left out."""
    if not text:
        return []
    text = text.replace("\r\n", "\n")
    if not text.isascii():
        text = unicodedata.normalize("NFC", repaired(text))
    if "`" in text:
        text = _INLINE.sub(" ", text)
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    text = _LOG.sub("", text)
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    out = []
    for paragraph in re.split(r"\n\s*\n", text):
        lines = []
        for line in paragraph.split("\n"):
            bare = line.lstrip()
            if bare.startswith("#"):
                if len(words_in(bare)) < 6 and not re.search(r"[.!?。！？]\s*$", bare):
                    lines.append(".")
                    continue
                bare = bare.lstrip("#")
            lines.append(_LEAD.sub("", bare))
        for s in _SENTENCE.split(" ".join(lines)):
            words = words_in(s)
            if words and sum(2 if c > "\u2fff" else 1 for w in words for c in w) >= 6 and (len(words) > 1 or words[0][0] > "\u2fff"):
                out.append(" ".join(words))
    return out


# ---------------------------------------------------------------------------------------------------------------------
def _sigmoid(x: np.ndarray) -> np.ndarray:
    # exp of float32 is vectorised, tanh isn't
    return np.float32(1) / (np.float32(1) + np.exp(-np.clip(x, np.float32(-30), np.float32(30))))


def _tanh(x: np.ndarray) -> np.ndarray:
    return np.float32(2) * _sigmoid(np.float32(2) * x) - np.float32(1)


class ByteGru:
    """Two GRUs over bytes, left to right and right to left, and a softmax over both at every position.

    All arrays have a leading axis of two directions; the second one reads its input reversed.
    """

    def __init__(self, n: int, hidden: int = HIDDEN, seed: int = 7):
        g = np.random.default_rng(seed)
        h = hidden
        self.p = {
            "x": g.normal(0, 0.3, (2, 257, 3 * h)).astype(np.float32),  # a byte's part of the three gates; 256 pads
            "u": (g.normal(0, 1, (2, h, 3 * h)) / np.sqrt(h)).astype(np.float32),
            "b": np.zeros((2, 1, 3 * h), np.float32),
            "o": (g.normal(0, 1, (2 * h, n)) / np.sqrt(2 * h)).astype(np.float32),
            "c": np.zeros(n, np.float32),
        }
        self.h = h
        self.p["b"][:, :, :h] = 1  # keeps more of the past at first

    def states(self, bytes_: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of both directions at every position: batch x time x 2 hidden."""
        n, t = bytes_.shape
        h, p = self.h, self.p
        both = np.stack([bytes_, bytes_[:, ::-1]])
        s = np.zeros((2, n, h), np.float32)
        gates, fresh = np.ascontiguousarray(p["u"][:, :, : 2 * h]), np.ascontiguousarray(p["u"][:, :, 2 * h :])
        out = np.empty((t, 2, n, h), np.float32)
        for i in range(t):
            col = both[:, :, i]
            x = np.stack([p["x"][0][col[0]], p["x"][1][col[1]]]) + p["b"]
            live = (col != 256)[:, :, None]
            g = _sigmoid(x[:, :, : 2 * h] + s @ gates)
            z, r = g[:, :, :h], g[:, :, h:]
            rs = r * s
            c = _tanh(x[:, :, 2 * h :] + rs @ fresh)
            new = np.where(live, z * s + (1 - z) * c, s)
            if keep is not None:
                keep.append((col, live, s, z, r, rs, c))
            s = out[i] = new
        return np.concatenate([out[:, 0].transpose(1, 0, 2), out[::-1, 1].transpose(1, 0, 2)], 2)

    def read(self, bytes_: np.ndarray) -> np.ndarray:
        """What :meth:`states` gives, in fewer passes over memory: nothing is kept for training.

        Signs and factors of the two activations are in the weights: 1 / (1 + exp(x)) of negated gates, and
        2 / (1 + exp(x)) - 1 of the doubled and negated candidate.
        """
        n, t = bytes_.shape
        h, p = self.h, self.p
        scale = np.repeat(np.float32([-1, -1, -2]), h)
        table = (p["x"] + p["b"]) * scale
        gates, fresh = np.ascontiguousarray(-p["u"][:, :, : 2 * h]), np.ascontiguousarray(-2 * p["u"][:, :, 2 * h :])
        both = np.stack([bytes_, bytes_[:, ::-1]])
        whole = (both != 256).all(1)
        s, x = np.zeros((2, n, h), np.float32), np.empty((2, n, 3 * h), np.float32)
        g, c = np.empty((2, n, 2 * h), np.float32), np.empty((2, n, h), np.float32)
        out = np.empty((t, 2, n, h), np.float32)
        one = np.float32(1)
        with np.errstate(over="ignore"):
            for i in range(t):
                for d in (0, 1):
                    np.take(table[d], both[d, :, i], axis=0, out=x[d])
                np.matmul(s, gates, out=g)
                g += x[:, :, : 2 * h]
                np.exp(g, out=g)
                g += one
                np.reciprocal(g, out=g)
                z = g[:, :, :h]
                np.matmul(g[:, :, h:] * s, fresh, out=c)
                c += x[:, :, 2 * h :]
                np.exp(c, out=c)
                c += one
                np.divide(np.float32(2), c, out=c)
                c -= one
                new = s - c
                new *= z
                new += c
                for d in (0, 1):
                    if not whole[d, i]:
                        gone = both[d, :, i] == 256
                        new[d, gone] = s[d, gone]
                s = out[i] = new
        return np.concatenate([out[:, 0].transpose(1, 0, 2), out[::-1, 1].transpose(1, 0, 2)], 2)

    def position_probabilities(self, bytes_: np.ndarray) -> np.ndarray:
        """Log-probabilities of the languages at every position."""
        y = self.read(bytes_) @ self.p["o"] + self.p["c"]
        y -= y.max(2, keepdims=True)
        return y - np.log(np.exp(y).sum(2, keepdims=True))

    def gradients(self, bytes_: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all positions and its gradients, by backpropagation through time."""
        keep: list = []
        h, p = self.h, self.p
        n, t = bytes_.shape
        hs = self.states(bytes_, keep)
        y = hs @ p["o"] + p["c"]
        y -= y.max(2, keepdims=True)
        e = np.exp(y)
        q = e / e.sum(2, keepdims=True)
        mask = bytes_ != 256
        count = max(1, int(mask.sum()))
        picked = np.take_along_axis(q, np.broadcast_to(target[:, None, None], (n, t, 1)), 2)[:, :, 0]
        loss = float(-(np.log(picked + 1e-9) * mask).sum() / count)
        q[np.arange(n)[:, None], np.arange(t)[None, :], target[:, None]] -= 1
        q *= mask[:, :, None] / np.float32(count)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["o"] = hs.reshape(-1, 2 * h).T @ q.reshape(-1, q.shape[2])
        g["c"] = q.sum((0, 1))
        dh = q @ p["o"].T
        direct = np.stack([dh[:, :, :h].transpose(1, 0, 2), dh[:, ::-1, h:].transpose(1, 0, 2)])  # 2 x t x n x h
        back = np.zeros((2, n, h), np.float32)
        to_gates = np.ascontiguousarray(p["u"][:, :, : 2 * h].transpose(0, 2, 1))
        to_new = np.ascontiguousarray(p["u"][:, :, 2 * h :].transpose(0, 2, 1))
        dx = np.empty((2, t, n, 3 * h), np.float32)
        for i in range(t - 1, -1, -1):
            _, live, s, z, r, rs, c = keep[i]
            d = direct[:, i] + back
            dl = d * live
            rest = 1 - z
            dc = dl * rest * (1 - c * c)
            drs = dc @ to_new
            dx[:, i, :, :h] = dl * (s - c) * z * rest
            dx[:, i, :, h : 2 * h] = drs * s * r * (1 - r)
            dx[:, i, :, 2 * h :] = dc
            back = np.where(live, dl * z, d) + drs * r + dx[:, i, :, : 2 * h] @ to_gates
        # the sums over time are taken at once
        for k in (0, 1):
            flat = dx[k].reshape(t * n, 3 * h)
            g["b"][k, 0] = flat.sum(0)
            g["u"][k, :, : 2 * h] = np.concatenate([x[2][k] for x in keep]).T @ flat[:, : 2 * h]
            g["u"][k, :, 2 * h :] = np.concatenate([x[5][k] for x in keep]).T @ flat[:, 2 * h :]
            col = np.concatenate([x[0][k] for x in keep])
            order = np.argsort(col, kind="stable")
            values, first = np.unique(col[order], return_index=True)
            g["x"][k][values] = np.add.reduceat(flat[order], first, axis=0)
        return loss, g

    def dump(self) -> dict:
        return {"h": self.h, "p": self.p}

    @classmethod
    def load(cls, data: dict) -> ByteGru:
        self = cls.__new__(cls)
        self.h, self.p = data["h"], data["p"]
        return self

    def log_pooled(self, texts: list[str]) -> np.ndarray:
        """Pooled log-probabilities of every text: the mean over its bytes, times a root of their number, normalised."""
        k = len(self.p["c"])
        total, count = np.zeros((len(texts), k)), np.zeros(len(texts))
        pieces = [(i, b[j : j + STRETCH]) for i, b in enumerate(t.encode("utf-8", "replace") for t in texts) for j in range(0, max(1, len(b)), STRETCH)]
        pieces.sort(key=lambda x: len(x[1]))
        for at in range(0, len(pieces), 512):
            part = pieces[at : at + 512]
            x = np.full((len(part), max(1, max(len(b) for _, b in part))), 256, np.int64)
            for row, (_, b) in enumerate(part):
                x[row, : len(b)] = np.frombuffer(b, np.uint8)
            y = (self.position_probabilities(x) * (x != 256)[:, :, None]).sum(1)
            for row, (i, b) in enumerate(part):
                total[i] += y[row]
                count[i] += len(b)
        y = total / np.sqrt(np.maximum(count, 1))[:, None]
        y -= y.max(1, keepdims=True)
        return y - np.log(np.exp(y).sum(1, keepdims=True))


def _plain(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if unicodedata.category(c) != "Mn")


def train(texts: list[str], labels: list[int], docs: list[int], weights: list[float], seed: int = 7) -> ByteGru:
    """Fit on sentences with the labels and numbers of their documents.

    At first languages come up by ``weights`` (what the corpus has of each), so the wrong labels of a rare
    language weigh little against the right ones of a common one; then documents and sentences that the
    network contradicts are dropped as mislabelled and all languages come up alike.
    """
    g = np.random.default_rng(seed)
    n = len(weights)
    net = ByteGru(n, seed=seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    y, doc = np.array(labels), np.array(docs)
    step = 0
    by = [np.flatnonzero(y == k) for k in range(n)]
    share = np.array(weights, float) ** 0.75
    share = np.maximum(share / share.sum(), 0.3 / n)
    for phase, rounds in enumerate((FIRST, SECOND)):
        if phase:
            where = {t: i for i, t in enumerate(dict.fromkeys(texts))}
            rows = net.log_pooled(list(where))[[where[t] for t in texts]]
            whole = np.zeros((doc.max() + 1, n))
            np.add.at(whole, doc, rows)
            agree = (whole.argmax(1)[doc] == y) & (rows[np.arange(len(y)), y] > np.log(0.3))
            by = [k[agree[k]] if agree[k].sum() >= 0.2 * len(k) else k for k in by]
            share = np.full(n, 1 / n)
        size = np.maximum(1, np.round(share / share.sum() * BATCH)).astype(int)
        for r in range(rounds):
            step += 1
            who = np.concatenate([g.choice(k, m) for k, m in zip(by, size) if len(k)])
            x = np.full((len(who), WINDOW), 256, np.int64)
            for row, i in enumerate(who):
                t = texts[i]
                chance = g.random()
                if chance < 0.15:
                    t = _plain(t)
                elif chance < 0.22:
                    t = t.lower()
                elif chance < 0.25:
                    t = t.upper()
                b = t.encode("utf-8")
                start = int(g.integers(0, max(1, len(b) - WINDOW + 1)))
                b = b[start : start + WINDOW]
                x[row, : len(b)] = np.frombuffer(b, np.uint8)
            _, grads = net.gradients(x, y[who])
            norm = np.sqrt(sum(float((v * v).sum()) for v in grads.values()))
            scale = min(1.0, 1.0 / (norm + 1e-9))
            rate = 0.012 * min(1.0, step / 20) * (1 - 0.9 * max(0, step - FIRST) / SECOND)
            for k, v in grads.items():
                m, w = moments[k]
                v = v * np.float32(scale)
                m += 0.1 * (v - m)
                w += 0.01 * (v * v - w)
                net.p[k] -= np.float32(rate) * (m / (1 - 0.9**step)) / (np.sqrt(w / (1 - 0.99**step)) + np.float32(1e-6))
    return net


# ---------------------------------------------------------------------------------------------------------------------
def segments(log_probs: np.ndarray) -> np.ndarray:
    """The language of every sentence: the best sequence with CHANGE nats for each change."""
    n, k = log_probs.shape
    best, back = log_probs[0].copy(), np.zeros((n, k), np.int64)
    for i in range(1, n):
        top = int(best.argmax())
        jump = best[top] - CHANGE
        stay = best >= jump
        back[i] = np.where(stay, np.arange(k), top)
        best = np.where(stay, best, jump) + log_probs[i]
    out = np.empty(n, np.int64)
    out[-1] = best.argmax()
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def _tokens(sentence: str) -> Iterator[str]:
    """The words of a sentence, and pairs of characters where words aren't parted."""
    for w in sentence.lower().split():
        if w[0] > "\u2fff":
            yield from (w[i : i + 2] for i in range(len(w) - 1))
        else:
            yield w


def learnable(by_label: dict[str, list[str]], common: set[str]) -> list[str]:
    """The labels that stand for a language of their own: the common ones, and rarer ones with words that those don't have."""
    seen = {w for k in common for x in by_label.get(k, []) for w in _tokens(x)}
    out = [k for k in by_label if k in common]
    for k in by_label.keys() - common:
        words = [w for x in by_label[k] for w in _tokens(x)]
        if words and sum(w in seen for w in words) <= KNOWN * len(words):
            out.append(k)
    return sorted(out)


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, weights: str | None = None) -> tuple[list[str], dict] | None:
    """Languages and a trained network from a bounded sample: SAMPLE_DOCS documents a label, SAMPLE_CHARS characters of each.

    With a folder ``weights`` (any file system) networks are kept there under a digest of their sample, and one
    that was trained on the same sample before is read instead of trained anew. None if nothing is labelled. See COMMON_SHARE for the labels that are learnt.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), language_code(F.col(lang_col)).alias("l")).where(F.col("l").isNotNull() & (F.length(F.trim("t")) > 0))
    counts = {r[0]: r[1] for r in rows.groupBy("l").count().collect()}  # at most one row per known language
    common = {k for k, c in counts.items() if c >= max(2, COMMON_SHARE * sum(counts.values()))}
    wanted = sorted(k for k, c in counts.items() if k in common or c >= LEAST_DOCS)
    if not wanted:
        return None
    w = Window.partitionBy("l").orderBy(F.xxhash64("id"), "id")
    sample = rows.where(F.col("l").isin(wanted)).select("id", "l", F.substring("t", 1, SAMPLE_CHARS).alias("t")).withColumn("k", F.row_number().over(w)).where(F.col("k") <= SAMPLE_DOCS)
    read = [(r["l"], number, sentences(r["t"])) for number, r in enumerate(sample.select("l", "t", "k").orderBy("l", "k").collect())]
    by_label: dict[str, list[str]] = {}
    for label, _, parts in read:
        by_label.setdefault(label, []).extend(parts)
    names = learnable(by_label, common)
    read = [(label, number, parts) for label, number, parts in read if label in names]
    texts = [x for _, _, parts in read for x in parts]
    if not texts:
        return None
    labels = [names.index(label) for label, _, parts in read for _ in parts]
    docs_of = [number for _, number, parts in read for _ in parts]
    shares = [counts[k] for k in names]
    made_of = (names, shares, FIRST, SECOND, HIDDEN, WINDOW, BATCH, texts, labels, docs_of)
    path = f"{weights}/{hashlib.sha256(pickle.dumps(made_of)).hexdigest()}" if weights else None
    net = _load(spark, path) if path else None
    if net is None:
        net = train(texts, labels, docs_of, shares).dump()
        if path:
            _save(spark, path, net)
    return names, net


def _save(spark, path: str, net: dict) -> None:
    rows = [(k, list(v.shape), bytearray(v.tobytes())) for k, v in net["p"].items()]
    spark.createDataFrame(rows, "name string, shape array<int>, data binary").coalesce(1).write.mode("ignore").parquet(path)


def _load(spark, path: str) -> dict | None:
    try:
        rows = spark.read.parquet(path).collect()
    except AnalysisException:
        return None
    p = {r["name"]: np.frombuffer(bytes(r["data"]), np.float32).reshape(r["shape"]).copy() for r in rows}
    return {"h": p["u"].shape[1], "p": p}


#: What a Python worker has read in the present run: sentences that come up again are not read again.
_memo: dict = {}


def _read_before(run_id: str) -> dict[str, np.ndarray]:
    """The sentences of this run that this worker knows; a worker serves many tasks, but one run at a time."""
    if _memo.get("run") != run_id:
        _memo.clear()
        _memo.update(run=run_id, known={})
    return _memo["known"]


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", weights: str | None = None) -> DataFrame:
    """One row per document and stretch of sentences in one language: id, label (code or null), segment, language, sentences, confidence, pooled.

    ``confidence`` is the segment's probability of its language; ``pooled`` that of the whole document, the mean
    over all its bytes of the probabilities of their sentences. ``weights``: see :func:`fit`. Texts without prose (null, empty, code only) have no row. Repeated rows are all labelled. Where no
    document carries a known label nothing can be learnt and the result is empty.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, label string, segment int, language string, sentences int, confidence double, pooled double"
    fitted = fit(docs, id_col, text_col, lang_col, weights)
    if fitted is None:
        return docs.sparkSession.createDataFrame([], schema)
    names, net = fitted
    sent = docs.sparkSession.sparkContext.broadcast(net)

    run_id = uuid.uuid4().hex

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = ByteGru.load(sent.value)
        known = _read_before(run_id)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                split = [sentences(t) for t in batch.column(2).to_pylist()]
                new = [s for s in dict.fromkeys(s for d in split for s in d) if s not in known]
                if len(known) + len(new) > 200_000:
                    known.clear()
                    new = list(dict.fromkeys(s for d in split for s in d))
                if new:
                    known.update(zip(new, net.log_pooled(new)))
                rows: list[list] = [[], [], [], [], [], [], []]
                for doc, label, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), split):
                    if not parts:
                        continue
                    p = np.stack([known[s] for s in parts])
                    lang = segments(p)
                    size = np.array([len(x.encode("utf-8", "replace")) for x in parts], float)
                    pooled = size @ np.exp(p) / size.sum()
                    edge = [0, *(np.flatnonzero(lang[1:] != lang[:-1]) + 1).tolist(), len(lang)]
                    for k, (a, b) in enumerate(zip(edge, edge[1:])):
                        q = p[a:b].sum(0)
                        q = np.exp(q - q.max())
                        for col, v in zip(rows, (doc, label, k, names[lang[a]], b - a, float(q[lang[a]] / q.sum()), float(pooled[lang[a]]))):
                            col.append(v)
                types = [batch.schema.field(0).type, pa.string(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, types)], names=[id_col, "label", "segment", "language", "sentences", "confidence", "pooled"])

    rows = spread(docs.select(id_col, F.col(lang_col), F.col(text_col).cast("string")), id_col)
    return rows.withColumn(lang_col, language_code(F.col(lang_col))).mapInArrow(run, schema)


def document_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", weights: str | None = None) -> DataFrame:
    """id, label, language, sentences, confidence: the languages that count in each document; ``confidence`` is the document's pooled probability.

    A language counts if it is the only one or has at least LEAST_SENTENCES sentences; if none has, the one
    with the highest pooled probability (then the first by name) does.
    """
    per = languages(docs, id_col, text_col, lang_col, weights).groupBy(id_col, "label", "language").agg(F.sum("sentences").alias("sentences"), F.max("pooled").alias("confidence"))
    enough = F.col("sentences") >= LEAST_SENTENCES
    w = Window.partitionBy(id_col).orderBy(enough.desc(), F.col("confidence").desc(), "language")
    return per.withColumn("place", F.row_number().over(w)).where((F.col("place") == 1) | enough).drop("place")


def wrong_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id_col``, ``language``: documents whose label is missing, unknown or wrong, and documents in several languages."""
    found = document_languages(docs, id_col, text_col, lang_col)
    w = Window.partitionBy(id_col)
    n, right = F.count(F.lit(1)).over(w), F.max(F.coalesce(F.col("label") == F.col("language"), F.lit(False))).over(w)
    return found.withColumn("n", n).withColumn("right", right).where((F.col("n") > 1) | ~F.col("right")).select(id_col, "language").distinct()
