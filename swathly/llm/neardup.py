"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find groups.

SuperMinHash gives each element a pseudo-random permutation of the ``SLOTS`` slots and the
values j + u, u in [0, 1), along it; a slot keeps its smallest value. Values of step j lie
in [j, j + 1), so a document stops as soon as every slot was met at an earlier step.

Documents with equal sets form a class, which one of them stands for. Classes that agree
in a band of ``ROWS`` slots are candidates. No bucket is expanded into all its pairs:
each round compares a bucket's members with one leader only, and merges what is linked;
members that a component already holds need no further comparison with each other. Rounds
end when they hardly link anything more. Then, without a cap, all that is left between
different components is compared: pairs of a sparse bucket as they are; members of a
crowded one (texts that share a passage, say, but little else) by an exact prefix filter,
where only texts that share one of their rarest fifth of shingles can be similar enough.

A pair at the threshold of 0.8 misses all ``BANDS`` bands with probability
(1 - 0.8^6)^42 < 3e-6; that is the only way to lose a link. Six slots a band keep chance
meetings rare: at a similarity of 0.3, which a shared passage may give, under 1 in 30.

Defined cases: a null or empty text has no shingles, is linked with nothing and kept;
rows without an id take the component of their class if it has an id, else null, and are
kept only in the latter case; rows that share an id are one document, linked by either
text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, KEY_TYPE, discard, free_names, materialize, release_shuffles, row_key, slices

SLOTS, BANDS, ROWS = 256, 42, 6
#: Star rounds at most; a round that links fewer than one pair in ``IDLE`` is the last one; a bucket with more open pairs than ``CROWD`` a member is crowded.
ROUNDS, IDLE, CROWD = 4, 20, 2

_U = np.uint64
_RNG = np.random.default_rng(7)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(_U)
_BASE, _A = _U(0x9E3779B97F4A7C15), _RNG.integers(1, 2**63, 16, dtype=np.int64).astype(_U) | _U(1)
#: A second, independent hash: together they name a shingle by 128 bits.
_BYTE2, _BASE2, _A2 = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(_U), _U(0xC2B2AE3D27D4EB4F), _RNG.integers(1, 2**63, 16, dtype=np.int64).astype(_U) | _U(1)
HASHES = ((_BYTE, _BASE, _A), (_BYTE2, _BASE2, _A2))
_IS_GAP = np.zeros(256, bool)
_IS_GAP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.frombuffer(ASCII_LOWER, np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(raws: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Two 64-bit hashes of the lower-cased words of all texts, and the number of the first word of each text (with an end)."""
    arr = _LOWER[np.frombuffer(b" ".join(raws) + b" ", np.uint8)]
    gap = _IS_GAP[arr]
    start = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    at = np.cumsum([0] + [len(r) + 1 for r in raws])
    first = np.searchsorted(start, at)
    if not len(start):
        return [np.zeros(0, _U)] * 2, first
    place = np.arange(len(arr))
    length = np.flatnonzero(~gap & np.concatenate([gap[1:], [True]])) - start + 1
    inside = place - np.repeat(start, np.diff(np.append(start, len(arr))))[: len(arr)] if start[0] == 0 else place - np.concatenate([np.zeros(start[0], np.int64), np.repeat(start, np.diff(np.append(start, len(arr))))])
    inside = np.minimum(inside, int(length.max()) - 1)
    out = []
    for table, base, a in HASHES:
        power = np.cumprod(np.full(int(length.max()), base))
        value = np.where(gap, _U(0), table[arr] * power[inside])
        out.append(mix(np.add.reduceat(value, start) + length.astype(_U) * a[15]))
    return out, first


def wide_sets(raws: list[bytes], size: int = 4) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct shingles, each by two hashes, in the order of the first one; fewer words are one shingle, no words none."""
    words, first = word_hashes(raws)
    runs = []
    for h, (_, _, a) in zip(words, HASHES, strict=True):
        r = np.zeros(max(len(h) - size + 1, 0), _U)
        for j in range(size):
            r += h[j : j + len(r)] * a[j]
        runs.append(mix(r + _U(size)))
    out = []
    for lo, hi in zip(first, first[1:], strict=False):
        if hi - lo >= size:
            x, y = runs[0][lo : hi - size + 1], runs[1][lo : hi - size + 1]
            order = np.argsort(x)
            x, y = x[order], y[order]
            new = np.concatenate([[True], x[1:] != x[:-1]])
            out.append((x[new], y[new]))
        elif hi > lo:
            out.append(tuple(mix((h[lo:hi] * a[8 : 8 + hi - lo]).sum(keepdims=True) + _U(hi - lo)) for h, (_, _, a) in zip(words, HASHES, strict=True)))
        else:
            out.append((np.zeros(0, _U), np.zeros(0, _U)))
    return out


def shingle_sets(raws: list[bytes], size: int = 4) -> list[np.ndarray]:
    """Per text the sorted distinct first hashes of its shingles."""
    return [x for x, _ in wide_sets(raws, size)]


def common(s: tuple[np.ndarray, np.ndarray], t: tuple[np.ndarray, np.ndarray]) -> int:
    """How many shingles two sets share, by all 128 bits."""
    if not len(s[0]) or not len(t[0]):
        return 0
    at = np.minimum(np.searchsorted(t[0], s[0]), len(t[0]) - 1)
    return int(((t[0][at] == s[0]) & (t[1][at] == s[1])).sum())


def _slot(key: np.ndarray, j: int) -> np.ndarray:
    """Where the permutation of each key sends step ``j``: odd factors, offsets and shifts are all bijections of 8 bits."""
    x, low = np.full(len(key), j, _U), _U(SLOTS - 1)
    for k, shift in ((0, 4), (17, 3), (34, 5)):
        x = (x * ((key >> _U(k)) | _U(1)) + (key >> _U(k + 8))) & low
        x ^= x >> _U(shift)
    return x.astype(np.int64)


def super_minhash(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, SLOTS) signatures: step in the top bits, the random part below."""
    sig = np.full((len(sets), SLOTS), _U(2**64 - 1))  # over every step
    flat = sig.reshape(-1)
    h = np.concatenate([*sets, np.zeros(0, _U)])
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    key = mix(h ^ _A[14])
    for j in range(SLOTS):
        if not len(h):
            break
        value = _U(j << 55) | (mix(h + _U((j + 1) * int(_BASE) % 2**64)) >> _U(9))
        np.minimum.at(flat, doc * SLOTS + _slot(key, j), value)
        open_ = (sig >= _U((j + 1) << 55)).any(1)[doc]
        if not open_.all():
            h, doc, key = h[open_], doc[open_], key[open_]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(texts, BANDS) 64-bit keys."""
    part = sig[:, : BANDS * ROWS].reshape(len(sig), BANDS, ROWS)
    out = np.zeros(part.shape[:2], _U) + np.arange(1, BANDS + 1, dtype=_U) * _A[13]
    for r in range(ROWS):
        out = mix(out ^ (part[:, :, r] * _A[r]))
    return out.view(np.int64)


def described(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, key, n, c1 and c2 (the class: 128 bits of the set, each half from another hash of its shingles), bands."""
    schema = f"doc_id long, key {KEY_TYPE}, n long, c1 long, c2 long, bands array<long>"

    def work(batches):
        for b in slices(batches):
            wide = wide_sets([(t or "").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()], size)
            sets = [x for x, _ in wide]
            keys = band_keys(super_minhash(sets))
            c = np.array([[mix(x).sum(dtype=_U), mix(y ^ _A[12]).sum(dtype=_U)] for x, y in wide], _U).reshape(-1, 2).view(np.int64)
            ends = pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1)))],
                names=["doc_id", "key", "n", "c1", "c2", "bands"],
            )

    return docs.select("doc_id", row_key().alias("key"), "text").mapInArrow(work, schema)


def texts_of(keys: DataFrame, docs: DataFrame) -> DataFrame:
    """key, text of the rows named, each once. The keys grow with the corpus, so they are merged at every size, never broadcast."""
    own = docs.select(row_key().alias("key"), "text").join(keys.hint("merge"), "key", "left_semi")
    return materialize(own.groupBy("key").agg(F.first("text").alias("text")), "texts")


def linked(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those pairs (a, na, b, nb: keys and nodes) whose full sets, by 128 bits a shingle, are similar enough, as edges u, v between nodes.

    Texts travel by key: each member's to its pair, then with it to its leader's; large keys are split by skew.
    """
    both = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")

    def work(batches):
        kept: tuple = (None, None)
        for batch in slices(batches, 128):
            keys = [tuple(k.values()) for k in batch.column("a").to_pylist()]
            raw = lambda c, batch=batch: [t.encode("utf-8", "surrogatepass") for t in batch.column(c).to_pylist()]
            own = wide_sets(raw("tb"), size)
            lead: dict = {kept[0]: kept[1]} if kept[0] is not None else {}
            new = list({k: i for i, k in reversed(list(enumerate(keys))) if k not in lead}.values())
            all_a = raw("ta")
            lead |= zip([keys[i] for i in new], wide_sets([all_a[i] for i in new], size) if new else [], strict=True)
            ok = []
            for k, s in zip(keys, own, strict=True):
                t = lead[k]
                both = common(s, t)
                ok.append(bool(both) and 100 * both >= percent * (len(s[0]) + len(t[0]) - both))
            if keys:
                kept = (keys[-1], lead[keys[-1]])
            hit = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([hit.column("na"), hit.column("nb")], names=["u", "v"])

    return both.select("a", "na", "nb", "ta", "tb").mapInArrow(work, "u long, v long").where("u <> v").distinct()


def local_forest(edges: DataFrame) -> DataFrame:
    """Union-find within each partition: every node's smallest, so that at most one edge per node is left."""

    def work(batches):
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for b in batches:
            for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
                x, y = find(u), find(v)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        out = [(x, r) for x in parent if (r := find(x)) != x]
        for at in range(0, len(out), 50_000):
            u, v = zip(*out[at : at + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return edges.select("u", "v").mapInArrow(work, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node with an edge: alternating large and small stars after a local union-find."""
    e = materialize(local_forest(edges).distinct(), "edges")
    state = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        last, e = e, materialize(down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).distinct(), "edges")
        discard(last)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now


def prefix_pairs(crowd: DataFrame, texts: DataFrame, size: int, percent: int, keep) -> DataFrame:
    """Pairs of different components among ``crowd`` (key, node, n, component) that share a shingle of their prefixes.

    Shingles are ordered by how many of these texts hold them, rarest first; two sets that
    are similar enough must meet within their first n - ceil(percent * n / 100) + 1, and
    from their first meeting on, enough places must be left for the overlap that their
    sizes ask for. Shingles that only one text holds come first and meet nothing.
    """

    def work(batches):
        for b in slices(batches):
            sets = shingle_sets([t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()], size)
            ends = pa.array(np.cumsum([0] + [len(x) for x in sets]), pa.int32())
            flat = pa.array(np.concatenate([*sets, np.zeros(0, _U)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.ListArray.from_arrays(ends, flat)], names=["key", "shingles"])

    each = keep(texts.join(crowd.select("key"), "key", "left_semi").mapInArrow(work, f"key {KEY_TYPE}, shingles array<long>"), "shingles").select("key", F.explode("shingles").alias("s"))
    shared = each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    own = each.join(shared, "s").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("s")).join(crowd, "key")
    alone = F.col("n") - F.size("s")
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    parts = own.withColumn("held", F.size("s")).where(prefix > alone).select("key", "node", "n", "component", "held", F.posexplode(F.slice("s", F.lit(1), (prefix - alone).cast("int"))).alias("i", "p")).select("key", "node", "n", "component", "p.s", (F.col("held") - F.col("i")).alias("rest"))
    parts = keep(parts, "prefixes")
    lead = parts.select("s", F.col("rest").alias("lrest"), *[F.col(k).alias(v) for k, v in _LEADER.items()])
    enough = (100 + percent) * F.least("rest", "lrest") >= percent * (F.col("n") + F.col("ln"))
    return parts.join(lead, "s").where((F.col("key") > F.col("a")) & enough & (F.col("component") != F.col("lc")))


_LEADER = {"node": "na", "key": "a", "n": "ln", "component": "lc"}


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept, and the row's key. The result is written; all that led to it is deleted."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    made: list[DataFrame] = []

    def keep(df: DataFrame, tag: str = "") -> DataFrame:
        made.append(materialize(df, tag) if tag else df)
        return made[-1]

    each = keep(described(docs, size), "sets")
    classes = keep(each.where("n > 0").groupBy("c1", "c2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("r"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    rows = classes.where("r.doc_id is not null").select(F.col("r.doc_id").alias("node"), F.col("r.key").alias("key"), "n", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count("*").alias("t")).where("t > 1").select("band")
    buckets = keep(rows.join(shared, "band"), "buckets")
    texts = keep(texts_of(buckets.select("key").distinct(), docs))
    release_shuffles(spark)
    state = {"edges": None, "tried": None}

    def settle(pairs: DataFrame) -> tuple[int, int]:
        """Compare those pairs that were not yet; how many, and how many linked."""
        similar_size = 100 * F.least("n", "ln") >= percent * F.greatest("n", "ln")
        pairs = pairs.where((F.col("component") != F.col("lc")) & similar_size).select(F.least("a", "key").alias("p"), F.greatest("a", "key").alias("q"), "a", "na", F.col("key").alias("b"), F.col("node").alias("nb"))
        pairs = pairs.dropDuplicates(["p", "q"])
        if state["tried"] is not None:
            pairs = pairs.join(state["tried"], ["p", "q"], "left_anti")
        pairs = keep(pairs, "pairs")
        found = keep(linked(pairs.select("a", "na", "b", "nb"), texts, size, percent), "links")
        for name, new in (("tried", pairs.select("p", "q")), ("edges", found)):
            state[name] = new if state[name] is None else state[name].union(new)
        release_shuffles(spark)
        return pairs.count(), found.count()

    # The leader: in the first round the smallest node, then a member of the bucket's largest component, another one each time.
    own = buckets.withColumn("component", F.col("node"))
    lead = own.groupBy("band").agg(F.min(F.struct("node", "key", "n", "component")).alias("l"))
    settle(own.join(lead.select("band", *[F.col(f"l.{k}").alias(v) for k, v in _LEADER.items()]), "band"))
    for turn in range(1, ROUNDS + 1):
        labels = keep(components(state["edges"]))
        own = buckets.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        parts = own.groupBy("band", "component").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64(F.lit(turn), "key").alias("x"), "node", "key", "n", "component")).alias("l"))
        per = parts.groupBy("band").agg(F.sum("size").alias("t"), F.sum(F.col("size") * F.col("size")).alias("q"), F.max(F.struct("size", F.xxhash64(F.lit(turn), "component"), "l")).alias("m")).where("t * t > q")
        per = keep(per.select("band", ((F.col("t") * F.col("t") - F.col("q")) / 2 > CROWD * F.col("t")).alias("crowded"), *[F.col(f"m.l.{k}").alias(v) for k, v in _LEADER.items()]), "open")
        tried, hit = settle(own.join(per, "band"))
        if not tried or IDLE * hit < tried:
            if hit:
                labels = keep(components(state["edges"]))
                own = buckets.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
            break
    lead = own.select("band", *[F.col(k).alias(v) for k, v in _LEADER.items()])
    sparse = own.join(per.where("not crowded").select("band"), "band").join(lead, "band").where(F.col("key") > F.col("a"))
    crowd = keep(own.join(per.where("crowded").select("band"), "band").select("key", "node", "n", "component").distinct(), "crowd")
    columns = ["a", "na", "ln", "lc", "key", "node", "n", "component"]
    settle(sparse.select(*columns).union(prefix_pairs(crowd, texts, size, percent, keep).select(*columns)))
    labels = keep(components(state["edges"]))
    named = classes.select("c1", "c2", F.col("r.doc_id").alias("node")).join(labels, "node", "left").select("c1", "c2", F.coalesce("component", "node").alias("class_id"))
    out = each.select("doc_id", "key", "n", "c1", "c2").join(named, ["c1", "c2"], "left")
    component = F.coalesce(F.when(F.col("n") > 0, F.col("class_id")), F.col("doc_id"))
    result = materialize(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.when(component.isNull(), True).otherwise(F.coalesce(F.col("doc_id") == component, F.lit(False))).alias("kept"), "key"), "duplicates")
    discard(*made)
    release_shuffles(spark)
    return result


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, columns as they were; rows that equal the kept one in id and text are reduced to one."""
    (own,) = free_names(docs, "row_key")
    kept = near_duplicates(docs, size, percent).where("kept").select(F.col("key").alias(own)).distinct()
    return docs.withColumn(own, row_key()).join(kept, own, "left_semi").dropDuplicates([own]).drop(own)
