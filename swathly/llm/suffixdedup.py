"""Suffix-array dedup: bytes inside strings of ``LENGTH`` bytes that also start earlier.

Which strings can repeat. Every window of ``LENGTH`` bytes is given to its anchor, the
place of the smallest hash among its runs of ``GRAM`` bytes (the leftmost one on ties).
Equal windows have equal anchors at equal places, so only anchors whose hash occurs again
matter; windows of one anchor are consecutive and make up its context. Of contexts that
are equal as a whole (64 bits of hash besides the anchor's 64) only the first is looked
at, the others are repeats from end to end.

How the rest is sorted. First contexts that share an anchor make a suffix bucket; one of
more than ``PER_BLOCK`` contexts is dealt to several blocks by a hash, so no task holds a
whole bucket however common its passage. Blocks are sorted one at a time by the
difference-cover method: a sample of suffixes, laid out from each anchor by a difference
cover of period ``PERIOD``, is ranked first by ``REACH`` bytes; windows are then ordered by
their first ``DEPTH`` bytes and, beyond them, by the rank of the last cover sample that they
hold whole, which stands at a common distance below ``PERIOD``, and the few bytes behind
that sample. Windows equal in all three are equal: the parts overlap and cover all ``LENGTH``
bytes. All of a class but its first start are repeats.

How blocks are merged. Of a bucket with several blocks, each block also hands on the first
window of each of its classes; these are grouped by their bytes (a sum per task before the
shuffle), and all but the first of a group are repeats, too.

Every stage writes its result to the shared folder.

Defined cases: a null text counts as empty; a text shorter than ``LENGTH`` bytes keeps all
its bytes; null ids come before all others, and rows that share an id (or have none) count
as one document: equal offsets in them are one start; equal rows share their ranges, which
are found once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEYS, discard, materialize, release_shuffles, row_keys, slices
from .neardup import mix

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1  # grams of a window
PERIOD, DEPTH, REACH = 31, 32, 70  # the last sample that a window holds whole starts at most PERIOD - 1 behind it
COVER = (0, 1, 3, 8, 12, 18)  # all differences modulo 31 occur
BLOCK = 1 << 20  # bytes of contexts of whole buckets sorted together
PER_BLOCK = 8_192  # contexts of one bucket sorted together, about
PIECE, PLACE_BITS = 1 << 17, 20  # texts hashed together; places in a piece

_U = np.uint64
_RNG = np.random.default_rng(11)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(_U)
_BASE = int(_RNG.integers(1, 2**62)) * 2 + 1
_PLACE = _U((1 << PLACE_BITS) - 1)
FIRST = -(2**63)  # stands for a missing id


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[_U(1)], np.full(n, _U(_BASE))]))


_UP = _powers(1 << 18)
_DOWN = np.cumprod(np.concatenate([[_U(1)], np.full(1 << 18, _U(pow(_BASE, -1, 2**64)))]))


def _more(n: int) -> None:
    """Powers for places up to ``n``."""
    global _UP, _DOWN
    if n >= len(_UP):
        _UP, _DOWN = _powers(2 * n), np.cumprod(np.concatenate([[_U(1)], np.full(2 * n, _U(pow(_BASE, -1, 2**64)))]))


def contexts(arr: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end (``ends``: where each stops): text, first window, number of windows, anchor's distance, its hash, the context's hash."""
    n = len(arr)
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if n < LENGTH:
        return none
    t = _BYTE[arr]
    h, d = t, 1
    while d < GRAM:
        h = h[:-d] * _U(pow(_BASE, d, 2**64)) + h[d:]
        d *= 2
    h = mix(h)
    m = (h & ~_PLACE) | np.arange(len(h), dtype=_U)
    d = 1
    while 2 * d <= SPAN:
        m = np.minimum(m[:-d], m[d:])
        d *= 2
    m = np.minimum(m[: n - LENGTH + 1], m[SPAN - d : SPAN - d + n - LENGTH + 1])
    starts = np.concatenate([[0], ends[:-1]])
    size = np.maximum(ends - starts - LENGTH + 1, 0)  # windows of each text
    text = np.repeat(np.arange(len(ends)), size)
    if not len(text):
        return none
    s = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
    at = (m[s] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    count = np.diff(np.append(new, len(s)))
    first, anchor = s[new], at[new]
    _more(n)
    total = np.concatenate([[_U(0)], np.cumsum(t * _UP[:n])])
    whole = mix((total[first + count - 1 + LENGTH] - total[first]) * _DOWN[first] + (anchor - first).astype(_U))
    own = text[new]
    return own, first - starts[own], count, anchor - first, h[anchor].view(np.int64), whole.view(np.int64)


def pieces(raws: list[bytes]):
    """(numbers, offsets, bytes, ends): texts put together up to ``PIECE`` bytes; one beyond the bound goes by pieces whose windows do not overlap."""
    most = 1 << (PLACE_BITS - 1)
    held, size = [], 0
    for i, raw in enumerate(raws):
        if len(raw) < LENGTH:
            continue
        for at in range(0, len(raw) - LENGTH + 1, most):
            part = raw[at : at + most + LENGTH - 1]
            if size + len(part) > PIECE and held:
                yield held
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield held


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(FIRST)).alias("d"), *row_keys(), "text")


def anchors(docs: DataFrame) -> DataFrame:
    """h, c, d, k1, k2, place: one row per context. ``place`` packs its first window, the anchor's distance and the number of windows."""
    names = ["h", "c", "d", *KEYS, "place"]

    def work(batches):
        for b in slices(batches):
            ids, k1, k2 = (b.column(c).to_numpy() for c in ("d", *KEYS))
            raws = [(t or "").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            for held in pieces(raws):
                number, offset = np.array([i for i, _, _ in held]), np.array([at for _, at, _ in held])
                arr = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
                own, first, count, dist, h, c = contexts(arr, np.cumsum([len(p) for _, _, p in held]))
                place = ((first + offset[own]) << 16) | (dist << 8) | count
                own = number[own]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, c, ids[own], k1[own], k2[own], place)], names=names)

    return _keyed(docs).mapInArrow(work, ", ".join(f"{n} long" for n in names))


_CUT = ["h", "block", "many", "d", *KEYS, "place"]


def cut_contexts(firsts: DataFrame, docs: DataFrame) -> DataFrame:
    """The contexts in ``firsts`` (h, block, many, k1, k2, place) with d and their bytes; a group is bounded by its document's length, and equal rows are cut once."""
    wanted = firsts.groupBy(*KEYS).agg(F.collect_list(F.struct("h", "block", "many", "place")).alias("w"))
    both = _keyed(docs).join(wanted, [*KEYS]).dropDuplicates([*KEYS])

    def work(batches):
        for b in slices(batches, 64):
            out = [[] for _ in range(len(_CUT) + 1)]
            for d, k1, k2, text, w in zip(*[b.column(c).to_pylist() for c in ("d", *KEYS, "text", "w")], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for x in w:
                    p = x["place"]
                    for col, v in zip(out, (x["h"], x["block"], x["many"], d, k1, k2, p, raw[p >> 16 : (p >> 16) + (p & 255) - 1 + LENGTH]), strict=True):
                        col.append(v)
            types = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 4, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[*_CUT, "bytes"])

    return both.mapInArrow(work, "h long, block long, many boolean, d long, k1 long, k2 long, place long, bytes binary")


#: From each residue of a place to the last place of the cover less than PERIOD behind it.
_TAKEN = np.isin(np.arange(PERIOD), COVER)
_STEP = np.array([max(k for k in range(PERIOD) if _TAKEN[(r + k) % PERIOD]) for r in range(PERIOD)])


def cover_ranks(arr: np.ndarray, word: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """At each sampled place its rank among all, by ``REACH`` bytes; equal bytes have equal ranks."""
    keys = [word[np.minimum(sample + j, len(word) - 1)] for j in [*range(0, REACH - 7, 8), REACH - 8]]
    order = np.lexsort(keys[::-1])
    differ = np.zeros(len(sample), bool)
    for k in keys:
        differ[1:] |= k[order][1:] != k[order][:-1]
    rank = np.zeros(len(arr), np.int64)
    rank[sample[order]] = np.cumsum(differ) + 1
    return rank


def sort_block(h: np.ndarray, d: np.ndarray, place: np.ndarray, raws: list[bytes], many: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Sort a block of contexts, in order of ``h``: the windows that also start earlier in it, as (context, first window, number) runs; and of contexts marked ``many`` the windows that do not, as (context, start, place in the joined bytes)."""
    count, dist, first = place & 255, place >> 8 & 255, place >> 16
    arr = np.frombuffer(b"".join(raws) + bytes(2 * LENGTH), np.uint8)
    size = np.array([len(r) for r in raws])
    base = np.cumsum(size) - size
    own = np.repeat(np.arange(len(raws)), count)
    w = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    # A window whose hash nothing else in the block has is no repeat and need not be sorted.
    of = np.repeat(np.arange(len(raws), dtype=np.int32), size)
    within = np.arange(len(of), dtype=np.int32) - base[of].astype(np.int32)
    total = np.concatenate([[_U(0)], np.cumsum(_BYTE[arr[: len(of)]] * _UP[within])])
    begin = base[own] + w
    digest = (total[begin + LENGTH] - total[begin]) * _DOWN[w]
    del total
    order = np.argsort(digest, kind="stable")
    same = digest[order][1:] == digest[order][:-1]
    some = np.zeros(len(own), bool)
    some[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]] = True
    late = np.zeros(len(own), bool)  # windows that also start earlier
    if some.any():
        twice = np.flatnonzero(some)
        own2, w2, at = own[twice], w[twice], begin[twice]
        rel = w2 - dist[own2]  # place from the anchor
        word = np.zeros(len(arr) - 8, _U)  # eight bytes from each place
        for j in range(8):
            word |= arr[j : j + len(word)].astype(_U) << _U(56 - 8 * j)
        # The cover sample: every place of a context that the cover, laid from its anchor, takes.
        rank = cover_ranks(arr, word, np.flatnonzero(_TAKEN[(within - dist[of].astype(np.int32)) % PERIOD]))
        bucket = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))[own2]
        step = _STEP[rel % PERIOD]
        # Bytes 0 to DEPTH, the sample's REACH bytes from ``step``, and the 12 or fewer behind it: at least the last 16.
        keys = [bucket * 512 + rel + 256, *[word[at + j] for j in range(0, DEPTH, 8)], rank[at + step], word[at + LENGTH - 16], word[at + LENGTH - 8]]
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order), bool)
        new[0] = True
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
        # Suffix order says nothing of where windows start, so a class is put in the order of its starts by itself.
        start, doc, kind = first[own2] + w2, d[own2], np.cumsum(new)
        again = np.lexsort([start[order], doc[order], kind])
        order, kind = order[again], kind[again]
        begins = np.concatenate([[True], kind[1:] != kind[:-1]])
        head = order[np.flatnonzero(begins)[np.cumsum(begins) - 1]]
        late[twice[order[(doc[order] != doc[head]) | (start[order] != start[head])]]] = True
    hit = np.flatnonzero(late)
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(hit) != 1) | (own[hit][1:] != own[hit][:-1])])) if len(hit) else np.zeros(0, np.int64)
    head = np.flatnonzero(~late & many[own])
    return (own[hit[cut]], (first[own] + w)[hit[cut]], np.diff(np.append(cut, len(hit)))), (own[head], (first[own] + w)[head], begin[head])


def sort_buckets(cut: DataFrame) -> DataFrame:
    """k1, k2, start, n: repeated windows of first contexts within their blocks; and with d and bytes, n null: what blocks of one bucket hand on. One block is in memory at a time."""
    names = [*KEYS, "start", "n", "d", "bytes"]
    types = [pa.int64()] * 5 + [pa.binary()]

    def work(batches):
        held: list = []
        size = 0

        def solve(rows):
            h, _, many, d, k1, k2, place, raws = zip(*rows, strict=True)
            d, k1, k2 = np.array(d), np.array(k1), np.array(k2)
            (which, start, n), (head, begin, at) = sort_block(np.array(h), d, np.array(place), list(raws), np.array(many, bool))
            nothing = lambda t, k: pa.nulls(k, t)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (k1[which], k2[which], start, n)] + [nothing(t, len(which)) for t in types[4:]], names=names)
            text = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b"".join(raws), np.uint8), LENGTH)
            for lo in range(0, len(head), 8192):
                o = head[lo : lo + 8192]
                flat = text[at[lo : lo + 8192]].tobytes()
                own = pa.Array.from_buffers(pa.binary(), len(o), [None, pa.py_buffer(np.arange(len(o) + 1, dtype=np.int32) * LENGTH), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([pa.array(k1[o]), pa.array(k2[o]), pa.array(begin[lo : lo + 8192], pa.int64()), nothing(pa.int64(), len(o)), pa.array(d[o]), own], names=names)

        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in (*_CUT, "bytes")], strict=True):
                # A bucket goes on alone once it has been dealt to several blocks, each of which fits.
                if held and row[:2] != held[-1][:2] and (size >= BLOCK or row[2] or held[-1][2]):
                    yield from solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[-1])
        if held:
            yield from solve(held)

    return cut.repartition("h", "block").sortWithinPartitions("h", "block").mapInArrow(work, "k1 long, k2 long, start long, n long, d long, bytes binary")


def merge_blocks(sorted_: DataFrame) -> DataFrame:
    """k1, k2, start, n: windows of one block that another block of the bucket has earlier. A group has one row per block, about."""
    each = sorted_.where("bytes is not null").select(*KEYS, "start", "d", "bytes")
    low = each.groupBy("bytes").agg(F.min(F.struct("d", "start")).alias("low"), F.count("*").alias("t")).where("t > 1")
    late = (F.col("d") != F.col("low.d")) | (F.col("start") != F.col("low.start"))
    return each.join(low, "bytes").where(late).select(*KEYS, "start", F.lit(1).cast("long").alias("n"))


def repeated_ranges(docs: DataFrame, per_block: int = PER_BLOCK) -> DataFrame:
    """k1, k2, start, n: all windows (runs of n) that also start earlier."""
    spark = docs.sparkSession
    every = anchors(docs)
    low = F.min(F.struct("d", "place"))
    again = every.groupBy("h").agg(F.count("*").alias("times"), F.min("c").alias("c1"), F.max("c").alias("c2"), low.alias("low")).where("times > 1")
    again = materialize(again.select("h", (F.col("c1") != F.col("c2")).alias("mixed"), "low"), "again")
    release_shuffles(spark)
    alike = lambda low: (F.col("d") == F.col(f"{low}.d")) & (F.col("place") == F.col(f"{low}.place"))
    # Anchors whose contexts are all equal are settled here: what is left of them is where their copies stand.
    more = lambda c: F.when(F.col("mixed"), F.col(c)).alias(c)
    hit = every.join(again, "h").where(F.col("mixed") | ~alike("low")).select(more("h"), more("c"), more("d"), *KEYS, "place", "mixed")
    hit = materialize(hit, "anchors")
    release_shuffles(spark)
    run = [*KEYS, F.shiftright("place", 16).alias("start"), F.col("place").bitwiseAND(255).alias("n")]
    whole = hit.where(~F.col("mixed")).select(*run)
    mixed = hit.where("mixed").select("h", "c", "d", *KEYS, "place")
    firsts = materialize(mixed.groupBy("h", "c").agg(F.min(F.struct("d", "place", *KEYS)).alias("f")), "firsts")
    # Written by itself: a passage that many documents share is one hot key of this join, which Spark splits.
    copies = materialize(mixed.join(firsts, ["h", "c"]).where(~alike("f")).select(*run), "copies")
    sizes = materialize(firsts.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"), "sizes")
    release_shuffles(spark)
    blocks = F.ceil(F.col("k") / per_block)
    dealt = F.pmod(F.xxhash64("f.k1", "f.k2", "f.place"), blocks)
    ones = firsts.join(sizes, "h").select("h", dealt.alias("block"), (blocks > 1).alias("many"), *[F.col(f"f.{k}").alias(k) for k in KEYS], F.col("f.place").alias("place"))
    cut = materialize(cut_contexts(ones, docs), "contexts")
    release_shuffles(spark)
    sorted_ = materialize(sort_buckets(cut), "sorted")
    discard(cut, firsts, sizes)
    release_shuffles(spark)
    own = sorted_.where("bytes is null").select(*KEYS, "start", "n")
    out = materialize(whole.union(copies).union(own).union(merge_blocks(sorted_)), "ranges")
    discard(again, hit, copies, sorted_)
    release_shuffles(spark)
    return out


def removed(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Per document what goes and what is left: doc_id, n_bytes, spans (byte offsets, ends exclusive, sorted and merged), kept (bytes)."""
    # Equal rows share a key and have found the same ranges.
    per_doc = ranges.distinct().groupBy(*KEYS).agg(F.collect_list(F.struct("start", "n")).alias("r"))
    both = docs.select("doc_id", *row_keys(), "text").join(per_doc, [*KEYS], "left").select("doc_id", "text", "r")
    names = ["doc_id", "n_bytes", "spans", "kept"]
    types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]

    def work(batches):
        for b in slices(batches, 256):
            rows = []
            for i, text, r in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("r").to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                kept, at, spans = [], 0, []
                for s, e in sorted((x["start"], x["start"] + x["n"] - 1 + LENGTH) for x in r or ()):
                    if s > at or not spans:
                        kept.append(raw[at:s])
                        spans.append({"start": s, "end": e})
                        at = s
                    if e > at:
                        spans[-1]["end"] = at = e
                kept.append(raw[at:])
                rows.append((i, len(raw), spans, b"".join(kept)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return both.mapInArrow(work, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def dedup_bytes(docs: DataFrame, per_block: int = PER_BLOCK) -> DataFrame:
    """The deduplicated documents, as ``removed`` has them."""
    docs = docs.select("doc_id", "text")
    return removed(docs, repeated_ranges(docs, per_block))


def dedup(docs: DataFrame, per_block: int = PER_BLOCK) -> DataFrame:
    """One row per document: bytes, removed bytes and spans, digest of the bytes that stay; all read off ``dedup_bytes``."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return dedup_bytes(docs, per_block).select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
