"""Token-ID output: one wavelet-matrix file per shard, with access, rank and select on compressed planes.

Documents are dealt by ranges of (id, hash of the text) and encoded in that order, equal
rows to several ranges where they are many; each gets an end id. A shard holds the ids of whole documents, at least ``SHARD`` of them
where there are as many. Its file has a header (document ids and lengths, zeros of each
plane, offsets of blocks and the ones before each) and, per bit of an id from the highest,
a plane of bits in the order of the planes above (zeros first), cut into blocks of
``BLOCK`` bits that are compressed one by one. Reading one id, counting an id up to a
place, or finding its k-th place decompresses a block per plane only.

Files are rows of a Parquet table (partition, number, bytes) in the shared folder: Spark's
own committer writes them, so a lost executor leaves no half-written shard.

Encoding calls the tokenizer once per distinct unit, as far as they are remembered. A unit ends where a single blank stands
between two other characters; no pre-token crosses such a place, so ids are the same as
those of the whole text.

Defined cases: a null text counts as empty and yields the end id alone; null ids come
first; rows with equal ids are ordered by their text's hash, then text; an empty table
gives no shards and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

END, SHARD, BLOCK = 0, 1 << 19, 1 << 18
MAGIC = b"WVMX1\n"
_SAFE = re.compile(r"(?<=\S)(?= \S)")
#: A blank at an end or beside other white space: such a text goes the plain way.
ODD = r"^ | $|\A \z| [\s\x{1c}-\x{1f}\x{85}\pZ]|[\s\x{0b}\x{1c}-\x{1f}\x{85}\pZ] | \x{0b}"
RUN, BYTES, MEMO = 128, 8 << 20, 800_000  # units encoded as one text; bytes of texts held at once; units remembered


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """A tokenizer over Arrow columns; ids as little-endian 16- or 32-bit integers."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        special = {t.content: len(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.units, self.pool, self.count = pa.array([], pa.string()), np.zeros(0, self.dtype), np.zeros(0, np.int64)
        self.width = np.array([special.get(t, len(t or "")) for t in map(self.tokenizer.id_to_token, range(size))], np.int64)  # bytes of each id

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, encoded as it is."""
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def after_blank(self, units: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units, each behind a blank, and how many each has. Many go at a time; where each ends is told by the bytes of its ids."""
        size = pc.binary_length(units).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        parts, counts = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for lo in range(0, len(units), RUN * 64):
            names = units.slice(lo, RUN * 64).to_pylist()
            runs = [names[at : at + RUN] for at in range(0, len(names), RUN)]
            found = self.tokenizer.encode_batch_fast([" " + " ".join(r) for r in runs], add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable([e.ids for e in found]), self.dtype)
            end = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(size[lo : lo + len(names)])) + 1
            parts.append(ids)
            counts.append(np.diff(end, prepend=0))
        return np.concatenate(parts), np.concatenate(counts)

    def remember(self, units: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The units' numbers in the memory, which learns the new ones, and its pool of ids and their counts."""
        if len(self.units) > MEMO:
            self.units, self.pool, self.count = units.slice(0, 0), self.pool[:0], self.count[:0]
        at = pc.index_in(units, value_set=self.units)
        new = units.filter(pc.is_null(at))
        known = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        known[known < 0] = len(self.units) + np.arange(len(new))
        ids, count = self.after_blank(new)
        self.units, self.pool, self.count = pa.concat_arrays([self.units, new]), np.concatenate([self.pool, ids]), np.concatenate([self.count, count])
        return known, self.pool, self.count

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column's texts one after another, and how many each has; nulls count as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.or_(pc.match_substring_regex(texts, ODD), pc.equal(texts, ""))
        rows = np.flatnonzero(~odd.to_numpy(zero_copy_only=False))
        cut = pc.split_pattern(texts.take(pa.array(rows)), " ")
        at = cut.offsets.to_numpy()
        table = cut.values.slice(int(at[0]), int(at[-1] - at[0])).dictionary_encode()
        number = table.indices.to_numpy().astype(np.int64)
        known, pool, count = self.remember(table.dictionary)
        number = known[number]
        first = at[:-1] - at[0]
        starts = self.plain(cut.values.take(pa.array(at[:-1])).to_pylist())  # without the blank
        slow = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        pieces = [p for text in texts.take(pa.array(slow)).to_pylist() for p in (self.plain(_SAFE.split(text)) if text else [])]
        # One list of units for all rows: numbers into the pool, which the first units and the odd rows' pieces extend.
        number[first] = len(count) + np.arange(len(first))
        n_slow = np.array([len(_SAFE.split(t)) if t else 0 for t in texts.take(pa.array(slow)).to_pylist()], np.int64)
        pool = np.concatenate([pool, *starts, *pieces])
        count = np.concatenate([count, [len(x) for x in starts], [len(x) for x in pieces]]).astype(np.int64)
        units = np.zeros(len(texts), np.int64)
        units[rows], units[slow] = np.diff(at), n_slow
        begin = np.cumsum(units) - units
        order = number
        if len(slow):
            order = np.empty(int(units.sum()), np.int64)
            for own, values in ((rows, number), (slow, len(count) - len(pieces) + np.arange(len(pieces)))):
                order[np.repeat(begin[own] - np.cumsum(units[own]) + units[own], units[own]) + np.arange(len(values))] = values
        total = np.concatenate([[0], np.cumsum(count[order])])
        ids, place = np.empty(int(total[-1]), self.dtype), (np.cumsum(count) - count).astype(np.int32)
        for lo in range(0, len(order), 1 << 18):  # by parts: places take more room than ids
            own = order[lo : lo + (1 << 18)]
            n, a, b = count[own], total[lo], total[min(lo + len(own), len(order))]
            ids[a:b] = pool.take(np.repeat(place[own] - (np.cumsum(n) - n).astype(np.int32), n) + np.arange(b - a, dtype=np.int32))
        return ids, total[begin + units] - total[begin]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One per Python worker, so that its memory serves all of the worker's tasks."""
    return Encoder(path)


# -- the file ----------------------------------------------------------------------


def build(ids: np.ndarray, doc_ids: list, lengths: list[int]) -> bytes:
    """A shard's file."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    zeros, sizes, ones, body = [], [], [], []
    a = ids
    for level in range(levels - 1, -1, -1):
        m = (a & a.dtype.type(1 << level)) != 0
        for at in range(0, len(a), BLOCK):
            part = m[at : at + BLOCK]
            raw = squeeze(np.packbits(part, bitorder="little").tobytes())
            sizes.append(len(raw))
            ones.append(int(np.count_nonzero(part)))
            body.append(raw)
        low = a.take(np.flatnonzero(~m))
        zeros.append(len(low))
        a = np.concatenate([low, a.take(np.flatnonzero(m))])
    head = json.dumps({"n": len(ids), "levels": levels, "zeros": zeros, "sizes": sizes, "ones": ones, "docs": doc_ids, "lengths": lengths}, separators=(",", ":")).encode()
    return MAGIC + struct.pack("<Q", len(head)) + head + b"".join(body)


class WaveletFile:
    """Queries on a shard's bytes (or a memory map of them)."""

    def __init__(self, raw):
        if bytes(raw[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        at = len(MAGIC) + 8
        size = struct.unpack("<Q", raw[len(MAGIC) : at])[0]
        head = json.loads(bytes(raw[at : at + size]))
        self.raw, self.n, self.levels, self.zeros = raw, head["n"], head["levels"], head["zeros"]
        self.docs, self.lengths = head["docs"], head["lengths"]
        self.blocks = -(-self.n // BLOCK)
        self.offset = np.concatenate([[0], np.cumsum(head["sizes"], dtype=np.int64)]) + at + size
        ones = np.array(head["ones"], np.int64).reshape(self.levels, self.blocks)
        self.before = np.concatenate([np.zeros((self.levels, 1), np.int64), np.cumsum(ones, 1)], 1)
        self._block = lru_cache(64)(self._read)

    def _read(self, level: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """A block's packed bits and the ones before each 64 of its bytes."""
        import zstandard

        k = level * self.blocks + block
        bits = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(self.raw[self.offset[k] : self.offset[k + 1]])), np.uint8)
        count = np.bitwise_count(np.pad(bits, (0, -len(bits) % 64)).reshape(-1, 64)).sum(1, dtype=np.int64)
        return bits, np.concatenate([[0], np.cumsum(count)])

    def _bit(self, level: int, i: int) -> int:
        bits, _ = self._block(level, i // BLOCK)
        return int(bits[i % BLOCK >> 3] >> (i & 7) & 1)

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, inside = divmod(i, BLOCK)
        total = int(self.before[level, block])
        if inside:
            bits, rank = self._block(level, block)
            b = inside >> 3
            total += int(rank[b >> 6]) + int(np.bitwise_count(bits[b >> 6 << 6 : b]).sum())
            if inside & 7:
                total += int(bits[b] & (1 << (inside & 7)) - 1).bit_count()
        return total

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.levels):
            bit, one = self._bit(level, i), self._ones(level, i)
            out = out << 1 | bit
            i = self.zeros[level] + one if bit else i - one
        return out

    def _interval(self, symbol: int, i: int) -> tuple[int, int]:
        """Where the first i places' copies of ``symbol`` stand below the last plane."""
        a, b = 0, i
        for level in range(self.levels):
            x, y = self._ones(level, a), self._ones(level, b)
            if symbol >> (self.levels - 1 - level) & 1:
                a, b = self.zeros[level] + x, self.zeros[level] + y
            else:
                a, b = a - x, b - y
        return a, b

    def rank(self, symbol: int, i: int) -> int:
        """How often ``symbol`` is among the first i ids."""
        if symbol < 0 or symbol >> self.levels:
            return 0
        a, b = self._interval(symbol, min(i, self.n))
        return b - a

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) ``bit`` of a plane."""
        edges = self.before[level] if bit else np.minimum(np.arange(self.blocks + 1) * BLOCK, self.n) - self.before[level]
        block = int(np.searchsorted(edges, k, "right")) - 1
        bits, _ = self._block(level, block)
        own = np.unpackbits(bits, bitorder="little")[: min(BLOCK, self.n - block * BLOCK)]
        return block * BLOCK + int(np.flatnonzero(own == bit)[k - int(edges[block])])

    def select(self, symbol: int, k: int) -> int:
        """Place of the k-th (from 0) ``symbol``."""
        if not 0 <= k < self.count(symbol):
            raise IndexError(k)
        at = self._interval(symbol, 0)[0] + k
        for level in range(self.levels - 1, -1, -1):
            bit = symbol >> (self.levels - 1 - level) & 1
            at = self._select_bit(level, bit, at - self.zeros[level] * bit)
        return at

    def occurrences(self, symbol: int):
        """All places of ``symbol``, one by one."""
        return (self.select(symbol, k) for k in range(self.count(symbol)))

    def all_ids(self, dtype=np.uint32) -> np.ndarray:
        """Every id in order, from the lowest plane up."""
        a = np.zeros(self.n, dtype)
        for level in range(self.levels - 1, -1, -1):
            bits = np.concatenate([self._read_plain(level, b) for b in range(self.blocks)]) if self.blocks else np.zeros(0, np.uint8)
            m = np.unpackbits(bits, bitorder="little")[: self.n].astype(bool)
            up = np.empty_like(a)
            up[np.flatnonzero(~m)] = a[: self.zeros[level]]
            up[np.flatnonzero(m)] = a[self.zeros[level] :] | dtype(1 << (self.levels - 1 - level))
            a = up
        return a

    def _read_plain(self, level: int, block: int) -> np.ndarray:
        import zstandard

        k = level * self.blocks + block
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(self.raw[self.offset[k] : self.offset[k + 1]])), np.uint8)


def by_bytes(batches):
    """Batches cut so that the texts of one take up about ``BYTES`` at most."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // BYTES
        cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        yield from (b.slice(lo, hi - lo) for lo, hi in zip(cut, cut[1:], strict=False) if hi > lo)


# -- the corpus --------------------------------------------------------------------


def write_shards(docs: DataFrame, tokenizer: str | None = None, shard: int = SHARD) -> DataFrame:
    """The written table of shards: part, seq, n_docs, n_ids, file."""
    path = tokenizer or default_tokenizer()
    schema = "part int, seq int, n_docs long, n_ids long, file binary"

    def work(batches):
        own, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        held, ids, lengths, size = [], [], [], 0

        def close():
            flat = np.concatenate(held)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([len(flat)], pa.int64()), pa.array([build(flat, ids, lengths)], pa.binary())], names=["part", "seq", "n_docs", "n_ids", "file"])

        for b in by_bytes(batches):
            flat, n = own.encode(b.column("text"))
            # The end id goes behind each document.
            flat = np.insert(flat, np.cumsum(n), own.dtype.type(END))
            n = n + 1
            names, ends, lo = b.column("doc_id").to_pylist(), np.cumsum(n), 0
            while lo < len(n):
                hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + shard - size)) + 1
                hi = min(hi, len(n))
                held.append(flat[ends[lo - 1] if lo else 0 : ends[hi - 1]])
                ids += names[lo:hi]
                lengths += n[lo:hi].tolist()
                size += len(held[-1])
                lo = hi
                if size >= shard:
                    yield close()
                    seq += 1
                    held, ids, lengths, size = [], [], [], 0
        if ids:
            yield close()

    # The row number only spreads equal rows, whose order does not matter, over more than one range.
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("r"))
    ordered = own.repartitionByRange(F.col("doc_id").asc_nulls_first(), "h", "r").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "text")
    return materialize(ordered.select("doc_id", "text").mapInArrow(work, schema), "shards")


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    sizes = shards.groupBy("part", "seq").agg(F.sum("n_ids").alias("n"))
    # Ids before each partition: one number per partition goes through the driver; within one, a window over its shards.
    per_part = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    base = dict(zip([r.part for r in per_part], np.concatenate([[0], np.cumsum([r.n for r in per_part], dtype=np.int64)]).tolist(), strict=False))
    from pyspark.sql import Window

    inside = F.sum("n").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    begins = sizes.select("part", "seq", F.coalesce(inside, F.lit(0)).alias("begin"))

    def work(batches):
        for b in slices(batches, 1):
            wave = WaveletFile(b.column("file")[0].as_py())
            flat = wave.all_ids(np.uint16 if wave.levels <= 16 else np.uint32)
            ends = np.cumsum(wave.lengths, dtype=np.int64)
            starts = ends - wave.lengths
            begin = base[b.column("part")[0].as_py()] + b.column("begin")[0].as_py()
            raw = memoryview(flat.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(wave.docs, pa.int64()), pa.array(starts + begin, pa.int64()), pa.array(wave.lengths, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "seq", "file").join(begins, ["part", "seq"]).select("part", "begin", "file").mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")
