"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

A logistic classifier over a text's shape gives each document a probability of good
quality (its evidence). Grouped sums of the evidence, its squares and counts describe every
path and host. The levels shrink one into the next: the mean of all documents is the hosts'
prior, a host's posterior the prior of its paths. How strongly comes from the data by the
method of moments for unequal groups: the prior counts as many documents as the variance
measured within sites is times the variance between them, so sites shrink wholly to their
parent where they differ no more than chance. A document's own evidence is left out of its
site's sums, since it counts for itself: its posterior odds are its own odds times the
path's odds relative to those of all other documents, to the power ``SITE_WEIGHT``.

Sums are of integers (millionths and their squares), so they do not depend on the order of
rows. A hot host costs one row per task before the shuffle; the way back is an equi-join
with one row per path, which Spark broadcasts only when it is small and otherwise splits by
skew. Only single rows (sums over all sites) reach the driver.

Training: at most ``SAMPLE`` labelled rows of at most ``LONGEST`` characters whose
crc32(id) mod 3 is not 1, by a hash of the id.

Defined cases: a null text counts as empty and gets the evidence of an empty text; a null
host or path is a site of its own; ids may be null or repeat (rows are judged one by
one); a document alone at its site gets the parent's posterior, one alone in the corpus its
own evidence; without labels the evidence is 0.5; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER, discard, materialize, slices
from .urlfilter import host_of, path_of

SAMPLE, LONGEST, HELD_OUT = 6_000, 20_000, 1
SITE_WEIGHT, CUT = 1.0, 0.5
UNIT = 1_000_000
_RUN = re.compile(r"[^\w\s]{2,}")


def shape(text: str) -> list[float]:
    """Numbers that describe a text's form, in one pass over its bytes each; linear in its length."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(len(raw), 1)
    words = text.split()
    k = max(len(words), 1)
    lines = text.split("\n")
    signs = len(_RUN.findall(text))
    of = lambda kind: len(raw) - len(raw.translate(None, kind))
    seen = Counter(words)
    return [
        np.log1p(k),
        n / k / 8,
        len(seen) / k,
        of(UPPER.encode()) / n * 10,
        of(b"0123456789") / n * 10,
        raw.count(b"|") / k,
        signs / k,
        of(b"#$%&*@<>{}[]=~^") / n * 10,
        of(b".!?") / k,
        raw.count(b",") / k,
        len(set(lines)) / len(lines),
        max(seen.values(), default=1) / k,
    ]


class Evidence:
    """A logistic model over standardised shape numbers and their squares."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.mean, self.scale, self.weights = mean, scale, weights

    def inputs(self, texts: list[str]) -> np.ndarray:
        x = (np.array([shape(t) for t in texts]).reshape(len(texts), -1) - self.mean) / self.scale
        x = np.clip(x, -4, 4)
        return np.concatenate([x, x * x, np.ones((len(x), 1))], 1)

    def probabilities(self, texts: list[str]) -> np.ndarray:
        if not len(self.weights) or not texts:
            return np.full(len(texts), 0.5)
        z = (self.inputs(texts) * self.weights).sum(1)
        return np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6)


def train(texts: list[str], labels: list[int]) -> Evidence:
    """Newton steps on a ridge-penalised likelihood."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Evidence(np.zeros(0), np.ones(0), np.zeros(0))
    raw = np.array([shape(t) for t in texts])
    model = Evidence(raw.mean(0), np.maximum(raw.std(0), 1e-6), np.zeros(2 * raw.shape[1] + 1))
    x = model.inputs(texts)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = np.round(w, 9)
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Evidence:
    own = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("y"))
    own = own.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != HELD_OUT).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").where(F.length("text") <= LONGEST)
    pick = texts.join(F.broadcast(own), "doc_id").orderBy("doc_id", "text").limit(rows).collect()  # ids of at most that many rows
    return train([r.text for r in pick], [r.y for r in pick])


def evidence(docs: DataFrame, model: Evidence, host: str, path: str) -> DataFrame:
    """doc_id, host, path and e: the evidence in millionths, kept off 0 and 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few numbers

    def work(batches):
        m = shared.value
        for b in slices(batches):
            p = m.probabilities([t or "" for t in b.column("text").to_pylist()])
            e = np.clip(np.rint(p * UNIT), 1000, UNIT - 1000).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("host"), b.column("path"), pa.array(e)], names=["doc_id", "host", "path", "e"])

    site = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))  # noqa: E731  a null site has a name of its own
    return docs.select("doc_id", site(host).alias("host"), site(path).alias("path"), "text").mapInArrow(work, "doc_id long, host string, path string, e long")


def pages_as_documents(pages: DataFrame) -> DataFrame:
    """doc_id, text, host, path of web pages: the text without scripts, styles and tags; the URL's host and the first part of its path."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    return pages.select(F.col("page_id").alias("doc_id"), bare.alias("text"), host_of(F.col("url")).alias("host"), F.regexp_extract(path_of(F.col("url")), r"^/?([^/]*)", 1).alias("path"))


def between(groups: int, n: int, within: float, spread: float, balance: float) -> tuple[float, float]:
    """Variance (within, between) of one level by the method of moments: ``within`` is the sum of squares inside groups, ``spread`` that of the groups' means about their parents', ``groups`` its degrees of freedom, ``balance`` what a unit of between-variance adds to it."""
    inside = within / n if n > 0 else 0.0
    outside = (spread - groups * inside) / balance if balance > 0 else 0.0
    return inside, max(outside, 0.0)


def strength(inside: float, outside: float) -> float | None:
    """Prior documents of a site; None where sites do not differ beyond chance."""
    return round(inside / outside, 9) if outside > 0 and inside / outside < 1e9 else None


def levels(paths: DataFrame, hosts: DataFrame) -> tuple[int, int, float | None, float | None]:
    """Documents and summed evidence of all, and the strengths of the priors of hosts and of paths, from single rows of sums over sites."""
    f = lambda c: F.col(c).cast("double")
    top = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.count("*").alias("k"), F.sum(f("hq") - f("hs") * f("hs") / f("hn")).alias("w"), F.sum(f("hn") * f("hn")).alias("nn")).first()
    if not top.n:
        return 0, 0, None, None
    mean = top.s / top.n
    spread = hosts.agg(F.sum(f("hn") * F.pow(f("hs") / f("hn") - mean, 2)).alias("v")).first().v
    host = strength(*between(top.k - 1, top.n - top.k, top.w, spread, top.n - top.nn / top.n))
    both = paths.join(hosts, "host")
    got = both.agg(F.count("*").alias("k"), F.sum(f("q") - f("s") * f("s") / f("n")).alias("w"), F.sum(f("n") * F.pow(f("s") / f("n") - f("hs") / f("hn"), 2)).alias("v"), F.sum(f("n") * f("n") / f("hn")).alias("nn")).first()
    return top.n, top.s, host, strength(*between(got.k - top.k, top.n - got.k, got.w, got.v, top.n - got.nn))


def site_quality(docs: DataFrame, model: Evidence, host: str = "source", path: str = "lang") -> DataFrame:
    """Per document: doc_id, evidence, host_posterior, path_posterior, quality, keep. The result is written."""
    each = materialize(evidence(docs, model, host, path), "evidence")
    square = F.col("e").cast("decimal(38,0)") * F.col("e").cast("decimal(20,0)")
    paths = materialize(each.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("e").alias("s"), F.sum(square.cast("decimal(38,0)")).alias("q")), "paths")
    hosts = materialize(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("q").alias("hq")), "hosts")
    n, total, strong_host, strong_path = levels(paths, hosts)

    def shrunk(total, count, strong, parent):
        """The posterior mean of a site from the others' sum and number, and its parent's posterior."""
        if strong is None:
            return parent
        return (total / UNIT + strong * parent) / (count + strong)

    e = F.col("e")
    p = e / UNIT
    prior = (F.lit(total) - e) / UNIT / (n - 1) if n > 1 else p
    host_post = shrunk(F.col("hs") - e, F.col("hn") - 1, strong_host, prior)
    path_post = shrunk(F.col("s") - e, F.col("n") - 1, strong_path, F.col("host_posterior"))
    off = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = lambda c: F.log(off(c) / (1 - off(c)))
    own = each.join(paths.join(hosts, "host").select("host", "path", "n", "s", "hn", "hs"), ["host", "path"])
    own = own.withColumn("prior", prior).withColumn("host_posterior", host_post).withColumn("path_posterior", path_post)
    score = F.round(1 / (1 + F.exp(-(odds(p) + SITE_WEIGHT * (odds(F.col("path_posterior")) - odds(F.col("prior")))))), 6)
    out = own.select("doc_id", F.round(p, 6).alias("evidence"), F.round("host_posterior", 6).alias("host_posterior"), F.round("path_posterior", 6).alias("path_posterior"), score.alias("quality"), (score >= CUT).alias("keep"))
    out = materialize(out, "quality")
    discard(each, paths, hosts)
    return out
