"""Toxicity: a convolutional text classifier trained in numpy.

Words are hashed twice, and their first ``STEM`` letters once, into ``BUCKETS`` rows of an
embedding table (the sum is the word's vector, so one chance collision moves a clean word
only part of the way). Filters of several widths run over the word sequence: short ones
with a weight for each place, wide ones (``WIDE``) with equal weights, which see how dense
telling words stand. Max pooling takes each filter's strongest window of the whole text,
and a logistic layer scores them. A threshold is calibrated
for each language, which is read off the text's own function words; the score is
shifted so that this threshold falls on ``CUT``.

Training uses at most ``SAMPLE`` labelled rows of at most ``LONGEST`` characters whose
crc32(id) mod 3 is not 1, chosen by a hash of the id: a documented bound, independent of
the corpus size. Every fifth of them is kept back: neither the log-odds that the embeddings
start from nor a gradient sees it, and the thresholds are calibrated on it alone. From the
second epoch on, a row labelled toxic that scores under ``TRIM`` is taken for mislabelled
and skipped. Words unseen in training have a zero vector.

Defined cases: a null text counts as empty; an empty text gets the score of a text
without any evidence; null ids hash as the empty text and are never trained on unless
labelled; repeated rows are scored one by one; without usable labels every score is the
prior 0.5. Labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, slices

BUCKETS, STEM, DIM, WIDTHS, WIDE, FILTERS = 1 << 20, 6, 8, (1, 2, 3), (48, 192), 4
POOLED = (len(WIDTHS) + len(WIDE)) * FILTERS
SAMPLE, LONGEST, HELD_OUT, CUT = 6_000, 20_000, 1, 0.7
EPOCHS, BATCH, RATE, TRIM = 6, 64, 0.02, 0.2
CHUNK = 200_000  # words convolved at once
SEED = 20_240_229
WORD = re.compile(r"\w+")
#: Frequent function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as was on are by this",
    "de": "der die und das den von zu mit sich auf für ist im nicht ein eine als",
    "fr": "le les des et en du une que est pour qui dans par au sur pas",
    "es": "el los las del y se por con una para su al lo como más",
}
LANGS = (*FUNCTION_WORDS, "other")


def _rows(word: str) -> tuple[int, int, int]:
    b = word.encode("utf-8", "surrogatepass")
    return zlib.crc32(b) % BUCKETS, zlib.crc32(b, 0x9E3779B9) % BUCKETS, zlib.crc32(word[:STEM].encode("utf-8", "surrogatepass"), 0x7F4A7C15) % BUCKETS


class Model:
    """Weights of a trained classifier; small, so it travels inside the task closure.

    ``table`` holds the rows of buckets that training moved; row 0 is the zero vector.
    """

    def __init__(self, row_of: dict[int, int], table: np.ndarray, filters: list[np.ndarray], bias: np.ndarray, out: np.ndarray, shift: dict[str, tuple[float, float]]):
        self.row_of, self.table, self.filters, self.bias, self.out, self.shift = row_of, table, filters, bias, out, shift
        self.memo: dict[str, tuple[int, int, int, int]] = {}
        self.lang_of = {w: k for k, (_, ws) in enumerate(FUNCTION_WORDS.items()) for w in ws.split()}

    def look(self, word: str) -> tuple[int, int, int, int]:
        get = self.row_of.get
        a, b, c = _rows(word)
        found = get(a, 0), get(b, 0), get(c, 0), self.lang_of.get(word, -1) + 1
        if len(self.memo) > 200_000:
            self.memo.clear()
        self.memo[word] = found
        return found

    def logits(self, texts: list[str]) -> tuple[np.ndarray, list[str]]:
        """Raw scores and the detected languages."""
        pooled = np.empty((len(texts), POOLED), np.float32)
        langs = np.zeros((len(texts), len(LANGS)), np.int64)
        group: list[list] = []
        first = held = 0
        for i, text in enumerate(texts):
            memo, look = self.memo, self.look
            ids = [memo.get(w) or look(w) for w in WORD.findall(text.lower())]
            if held + len(ids) > CHUNK and group:
                self._pool(group, pooled[first:i], langs[first:i])
                group, first, held = [], i, 0
            group.append(ids)
            held += len(ids)
        if group:
            self._pool(group, pooled[first:], langs[first:])
        best = langs[:, : len(LANGS) - 1]
        names = [LANGS[k] if n else "other" for k, n in zip(best.argmax(1), best.max(1), strict=True)] if len(texts) else []
        return pooled @ self.out[:-1] + self.out[-1], names

    def _pool(self, group: list[list], pooled: np.ndarray, langs: np.ndarray) -> None:
        """Convolve a run of documents, each followed by a gap, and pool by document; a very long one goes by slices that overlap."""
        gap = max(WIDTHS) - 1
        pooled[:] = -np.inf
        parts = [(d, ids[at : at + CHUNK + max(WIDE)]) for d, ids in enumerate(group) for at in range(0, max(1, len(ids)), CHUNK)]
        flat = np.zeros((sum(len(p) + gap for _, p in parts), 4), np.int32)
        starts, at, ends = [], 0, np.empty(len(flat), np.int64)
        for _, p in parts:
            if p:
                flat[at : at + len(p)] = p
            starts.append(at)
            ends[at : at + len(p) + gap] = at + len(p)
            at += len(p) + gap
        x = self.table[flat[:, 0]] + self.table[flat[:, 1]] + self.table[flat[:, 2]]
        y = convolve(x, ends, self.filters, self.bias)
        owner = np.array([d for d, _ in parts])
        for k in np.flatnonzero(owner[1:] == owner[:-1]):  # windows that the next slice has whole
            y[starts[k] + CHUNK : starts[k + 1]] = -np.inf
        by_part = np.maximum.reduceat(y, starts, axis=0)
        np.maximum.at(pooled, owner, by_part)
        np.maximum(pooled, 0, out=pooled)
        for d, ids in enumerate(group):  # whole documents: slices overlap
            if ids:
                langs[d] = np.bincount(np.fromiter((i[3] for i in ids), np.int64, len(ids)), minlength=len(LANGS) + 1)[1 : len(LANGS) + 1]

    def scores(self, texts: list[str]) -> np.ndarray:
        raw, langs = self.logits(texts)
        at, scale = np.array([self.shift[g] for g in langs]).reshape(-1, 2).T
        z = (raw - at) * scale + np.log(CUT / (1 - CUT))
        return np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 9)


def convolve(x: np.ndarray, ends: np.ndarray, filters: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    """(n, POOLED): window j of a width starts at word j and ends with its document, at the gap after it or at ``ends``."""
    n, out = len(x), []
    for w, f in zip(WIDE, filters[len(WIDTHS) :], strict=True):  # (1, DIM, FILTERS)
        total = np.concatenate([np.zeros((1, FILTERS)), np.cumsum(x @ f[0], 0, dtype=np.float64)])
        at = np.arange(n)
        out.append((total[np.maximum(np.minimum(at + w, ends), at)] - total[at]).astype(np.float32))
    wide, out = out, []
    for f in filters[: len(WIDTHS)]:  # (width, DIM, FILTERS)
        y = x @ f[0]
        for k in range(1, len(f)):
            y[: n - k] += x[k:] @ f[k]
        out.append(y)
    return np.concatenate(out + wide, 1) + bias


def distinct_rows(texts: list[str]) -> list[int]:
    """Rows without those that share one of four shingle minima with an earlier row: copies are not independent evidence."""
    seen, out = set(), []
    for i, text in enumerate(texts):
        words = WORD.findall(text.lower())
        grams = {zlib.crc32(" ".join(words[k : k + 3]).encode("utf-8", "surrogatepass")) for k in range(max(1, len(words) - 2))}
        h = np.fromiter(grams, np.uint64, len(grams))
        marks = {(k, int((h * np.uint64(a) & np.uint64(0xFFFFFFFFFFFF)).min())) for k, a in enumerate((2654435761, 40503 * 65537 + 2, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))}
        if not marks & seen:
            out.append(i)
        seen |= marks
    return out


def train(texts: list[str], labels: list[int], ids: list) -> Model:
    """Fit on these rows alone, one of each group of copies; every fifth by crc32 is kept back to calibrate the thresholds."""
    rng = np.random.default_rng(SEED)
    one = distinct_rows(texts)
    texts, labels, ids = ([x[i] for i in one] for x in (texts, labels, ids))
    y = np.array(labels, np.float32)
    number: dict[str, int] = {}  # each word once, so that a text takes up four bytes a word
    numbered = [np.fromiter((number.setdefault(w, len(number)) for w in WORD.findall(t.lower())), np.int32) for t in texts]
    keys = np.array([_rows(w) for w in number], np.int32).reshape(-1, 3)
    del number
    kept = np.array([zlib.crc32(b"c" + str(i).encode()) % 5 != 0 for i in ids], bool)
    if kept.all() or y[kept].sum() in (0, kept.sum()) if len(y) else True:
        kept[:] = True
    buckets, rows_of = np.unique(keys, return_inverse=True)
    rows_of = rows_of.reshape(-1, 3).astype(np.int32) + 1
    # Start from evidence: the first number of a bucket is the smoothed log-odds of its documents, where that is beyond chance.
    pos, neg = np.zeros(len(buckets) + 1), np.zeros(len(buckets) + 1)
    fit = np.flatnonzero(kept)
    for k in fit:
        (pos if y[k] else neg)[np.unique(rows_of[numbered[k]])] += 1
    n1, n0 = float(y[fit].sum()), float((1 - y[fit]).sum())
    # A bucket counts only where its G statistic would not arise by chance among all buckets (labels may be noisy).
    k, base = pos + neg, (n1 + 0.5) / (n1 + n0 + 1)
    rate = np.clip(pos / np.maximum(k, 1), 1e-9, 1 - 1e-9)
    g_stat = 2 * (pos * np.log(rate / base) + neg * np.log((1 - rate) / (1 - base)))
    often = k >= 4  # fewer documents show nothing, so they do not count as tries either
    sure = often & (g_stat > 2 * np.log(often.sum() + 1) + 2)
    odds = np.log((pos + 0.5) / (n1 + 1)) - np.log((neg + 0.5) / (n0 + 1))
    table = np.zeros((len(buckets) + 1, DIM), np.float32)
    table[:, 0] = np.where(sure, odds / 4, 0)
    table[0] = 0
    filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in (*WIDTHS, *[1] * len(WIDE))]
    for f in filters:
        f[0, 0, : FILTERS // 2] += 0.5
    bias = np.full(POOLED, -0.3, np.float32)
    out = np.append(np.full(POOLED, 0.2), -1).astype(np.float32)
    weight = np.where(y == 1, (n0 + 1) / (n1 + 1), 1.0).clip(0.2, 20)
    for epoch in range(EPOCHS if n1 and n0 else 0):
        rate = RATE / (1 + epoch)
        for at in range(0, len(order := rng.permutation(fit)), BATCH):
            grads = [np.zeros_like(f) for f in filters]
            g_bias, g_out = np.zeros_like(bias), np.zeros_like(out)
            for d in order[at : at + BATCH]:
                rows = rows_of[numbered[d]]
                if not len(rows):
                    continue
                x = np.concatenate([table[rows].sum(1), np.zeros((max(WIDTHS) - 1, DIM), np.float32)])
                h = convolve(x, np.full(len(x), len(rows)), filters, bias)
                top = h.argmax(0)
                v = np.maximum(h[top, np.arange(h.shape[1])], 0)
                p = 1 / (1 + np.exp(-np.clip(v @ out[:-1] + out[-1], -30, 30)))
                if epoch and y[d] and p < TRIM:  # taken for a wrong label
                    continue
                g = np.float32((p - y[d]) * weight[d])
                gv = g * out[:-1] * (v > 0)
                g_out += np.append(g * v, g).astype(np.float32)
                g_bias += gv
                for c in np.flatnonzero(gv):
                    k, f, q = c // FILTERS, c % FILTERS, top[c]
                    if k < len(WIDTHS):
                        w = WIDTHS[k]
                        grads[k][:, :, f] += gv[c] * x[q : q + w]
                        own, step = rows[q : q + w], gv[c] * filters[k][: len(rows[q : q + w]), :, f]
                    else:
                        w = WIDE[k - len(WIDTHS)]
                        grads[k][0, :, f] += gv[c] * x[q : min(q + w, len(rows))].sum(0)
                        own = rows[q : q + w]
                        own = own[np.abs(table[own]).max((1, 2)) > 0]
                        step = np.broadcast_to(gv[c] * filters[k][0, :, f], (len(own), DIM))
                    if epoch and len(own):
                        np.subtract.at(table, own, rate * step[:, None, :])
            size = len(order[at : at + BATCH])
            for f, gr in zip(filters, grads, strict=True):
                f -= rate * (gr / size + 1e-4 * f)
            bias -= rate * g_bias / size
            out -= rate * g_out / size
    live = np.abs(table).max(1) > 1e-3
    live[0] = True
    rows = np.cumsum(live) - 1
    model = Model({int(b): int(rows[k + 1]) for k, b in enumerate(buckets) if live[k + 1]}, table[live], filters, bias, out, {g: (0.0, 1.0) for g in LANGS})
    if n1 and n0:
        raw, langs = model.logits(texts)
        use = np.flatnonzero(~kept) if (~kept).any() and 0 < y[~kept].sum() < (~kept).sum() else np.arange(len(y))
        none = float(model.logits([""])[0][0])
        common = threshold(raw[use], y[use], none)
        for g in LANGS:
            own = use[[langs[i] == g for i in use]]
            enough = len(own) and y[own].sum() >= 10 and (1 - y[own]).sum() >= 10
            model.shift[g] = threshold(raw[own], y[own], none) if enough else common
    model.memo.clear()
    return model


def threshold(raw: np.ndarray, y: np.ndarray, none: float) -> tuple[float, float]:
    """(cut, scale): the cut of best F1, in the middle of the gap to the next lower score; the scale makes a typical distance 3 logits.

    The cut stays above ``none``, the score of a text without evidence.
    """
    order = np.argsort(-raw, kind="stable")
    s, hit = raw[order].astype(float), np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # a cut cannot part equal scores
    f1[s <= none + 1e-6] = -1
    k = int(np.argmax(f1))
    if f1[k] < 0:
        return none + 1.0, 3.0
    below = max(s[k + 1] if k + 1 < len(s) else none, none)
    cut = (s[k] + below) / 2
    return float(cut), float(3 / max(np.median(np.abs(s - cut)), 1e-3))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> tuple[list, list, list]:
    """At most ``rows`` labelled training rows, by a hash of the id; conflicting labels of an id count as toxic."""
    own = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    own = own.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != HELD_OUT).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").where(F.length("text") <= LONGEST)
    pick = texts.join(F.broadcast(own), "doc_id").orderBy("doc_id", "text").limit(rows).collect()  # ids of at most that many rows
    return [r.text for r in pick], [r.y for r in pick], [r.doc_id for r in pick]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model:
    return train(*sample(docs, labels, rows))


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    names = ["doc_id", "held_out", "score", "predicted"]

    def work(batches):
        m = shared.value
        for b in slices(batches):
            ids, s = b.column("doc_id").to_pylist(), m.scores([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([crc_mod(i) == HELD_OUT for i in ids], pa.bool_()), pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32))], names=names)

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the classifier does not reject, columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        m = shared.value
        for b in slices(batches):
            yield b.filter(pa.array(m.scores([t or "" for t in b.column("text").to_pylist()]) < CUT))

    return docs.mapInArrow(work, docs.schema)
