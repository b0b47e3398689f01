"""SentencePiece encoding and decoding: N-best segmentations of the piece lattice.

Forward Viterbi scores of the lattice are exact heuristics for a backward A* search from
the end of the text, so hypotheses leave the agenda in order of their full score.

The lattice falls apart between two characters that no piece has side by side (so, runs
of blanks apart, which carry the score of never being used, before every blank).
Segments between such places are solved together with numpy, each distinct one once a batch: the forward and
backward passes give its best score, its best path, and the smallest loss of any other
path (the best path through each edge off the best one). The N best of a whole text
deviate from the best in at most N - 1 segments, and only in those with the smallest
losses, hence A* runs on these few segments and their lists are merged. The result is
exact, for texts of any length.

Characters outside the vocabulary fall back to their UTF-8 byte pieces. Equal scores come
in the fixed order of the search.

Defined cases: null and empty texts have no pieces, score 0, one hypothesis and decode
to the empty text; ids may be null or repeat; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

BLANK = "▁"
#: What one byte piece costs, as a whole number below every piece's score.
BYTE_SCORE = -40_000.0
UNUSED = -1e8
LONG = 48  # longer segments are cut by the plain program one character after another


class Lattice:
    """Pieces of a model and the N-best search over them."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.piece = pieces
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(pieces) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.id_of = {p: i for i, p in enumerate(pieces) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and sp.get_score(i) > UNUSED and BLANK not in p[1:]}
        self.score = {p: float(sp.get_score(i)) for p, i in self.id_of.items()}
        self.longest = max(map(len, self.id_of))
        self.starts = {p[:1] for p in self.id_of}
        # Pieces by a hash of their characters, for lookups of many substrings at once.
        by_hash = {}
        for p, i in self.id_of.items():
            h = 0
            for c in p:
                h = (h * 1_000_003 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            if h in by_hash:
                raise ValueError("two pieces share a hash")
            by_hash[h] = (i, self.score[p])
        self.hashes = np.array(sorted(by_hash), np.uint64)
        self.hash_ids = np.array([by_hash[int(h)][0] for h in self.hashes], np.int32)
        self.hash_scores = np.array([by_hash[int(h)][1] for h in self.hashes])
        # A small first filter: most substrings are no piece.
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.hashes >> np.uint64(7)) & np.uint64(0x3FFFFF)] = True
        self.memo: dict[str, list] = {}
        # Neighbours inside pieces, by a hash; a chance hit only means that a text isn't cut there.
        self.joined = np.zeros(1 << 22, bool)
        for p in self.id_of:
            c = np.array([ord(x) for x in p], np.uint64)
            self.joined[self._pair(c)] = True

    # -- one segment, edge by edge -------------------------------------------------

    def edges_into(self, s: str, end: int):
        """(start, score, ids) of the edges that enter ``end``; a byte fallback comes last."""
        found = False
        for start in range(max(0, end - self.longest), end):
            p = s[start:end]
            i = self.id_of.get(p)
            if i is not None:
                found |= start == end - 1
                yield start, self.score[p], (i,)
        if not found:
            raw = s[end - 1].encode("utf-8", "surrogatepass")
            yield end - 1, BYTE_SCORE * len(raw), tuple(self.byte_id[b] for b in raw)

    def entering(self, s: str):
        """A function from a place to the edges that enter it; those of a short segment are kept, others looked up each time."""
        if len(s) <= LONG:
            return [[], *(list(self.edges_into(s, end)) for end in range(1, len(s) + 1))].__getitem__
        return lambda end: self.edges_into(s, end)

    def forward(self, s: str, into) -> array:
        """Best score of every prefix, eight bytes a character."""
        best = array("d", [-np.inf]) * (len(s) + 1)
        best[0] = 0.0
        for end in range(1, len(s) + 1):
            best[end] = max([best[start] + score for start, score, _ in into(end)])
        return best

    def a_star(self, s: str, n: int) -> list[tuple[float, tuple]]:
        """The n best segmentations (score, ids), best first; backward from the end, with the forward scores as exact heuristics.

        As heuristics are exact, every entry of the agenda has a completion of just its score; so
        what is not among the n best entries cannot become one of the n best hypotheses, and the
        agenda never needs more room, however long the segment is.
        """
        if (got := self.memo.get(s)) is not None and len(got) >= n:
            return got[:n]
        into = self.entering(s)
        best = self.forward(s, into)
        # Equal scores: the hypothesis nearest to the start goes on first, so ties never widen the search.
        agenda, out, made = [(-best[len(s)], len(s), 0, 0.0, None)], [], 0
        while agenda and len(out) < n:
            cost, at, _, tail, node = agenda.pop(0)
            if at == 0:
                ids: list[int] = []
                while node:
                    own, node = node
                    ids += own
                out.append((-cost, tuple(ids)))
                continue
            for start, score, own in into(at):
                made += 1
                entry = (-(best[start] + score + tail), start, made, score + tail, (own, node))
                if len(agenda) < n - len(out) or entry < agenda[-1]:
                    insort(agenda, entry)
                    del agenda[n - len(out) :]
        if len(s) <= LONG:
            if len(self.memo) > 50_000:
                self.memo.clear()
            self.memo[s] = out[:n]
        return out[:n]

    def best_path(self, s: str) -> tuple[float, tuple, float]:
        """Best score, its ids, and the smallest loss of another path, by the plain program; memory as in ``forward``."""
        into = self.entering(s)
        best = self.forward(s, into)
        at, ids, come = len(s), [], array("q", [-1]) * (len(s) + 1)  # come: where the best path's edge into a place begins
        while at:
            start, score, own = min((e for e in into(at) if best[e[0]] + e[1] == best[at]), key=lambda e: e[0])
            come[at] = start
            ids.append(own)
            at = start
        back = array("d", [-np.inf]) * (len(s) + 1)
        back[len(s)], other = 0.0, -np.inf
        for end in range(len(s), 0, -1):  # every edge that leaves ``end`` has been met already
            for start, score, _ in into(end):
                back[start] = max(back[start], score + back[end])
                if come[end] != start:
                    other = max(other, best[start] + score + back[end])
        return best[len(s)], tuple(i for own in reversed(ids) for i in own), best[len(s)] - other

    # -- many segments at once -----------------------------------------------------

    def solve(self, segments: list[str]) -> dict[str, tuple[float, tuple, float]]:
        """``best_path`` of each segment; short ones of a length go through numpy together."""
        out, by_len = {}, {}
        for s in segments:
            if len(s) > LONG:
                out[s] = self.best_path(s)
            else:
                by_len.setdefault(len(s), []).append(s)
        for n, group in by_len.items():
            for at in range(0, len(group), 20_000):
                part = group[at : at + 20_000]
                out.update(zip(part, self._solve_equal(part, n), strict=True))
        return out

    def _solve_equal(self, group: list[str], n: int):
        k = len(group)
        codes = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(k, n).T.astype(np.uint64) + np.uint64(1)
        width = np.full((n, k), BYTE_SCORE)  # byte fallback by the UTF-8 length
        c = codes - np.uint64(1)
        width *= 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
        edge: dict[tuple[int, int], np.ndarray] = {}
        edge_id: dict[tuple[int, int], np.ndarray] = {}
        mult = np.uint64(1_000_003)
        with np.errstate(over="ignore"):
            for a in range(n):
                h = np.zeros(k, np.uint64)
                for b in range(a + 1, min(n, a + self.longest) + 1):
                    h = h * mult + codes[b - 1]
                    score, ids = np.full(k, -np.inf), np.full(k, -1, np.int32)
                    may = np.flatnonzero(self.filter[(h >> np.uint64(7)) & np.uint64(0x3FFFFF)])
                    if len(may):
                        at = np.searchsorted(self.hashes, h[may])
                        at[at == len(self.hashes)] = 0
                        hit = self.hashes[at] == h[may]
                        score[may[hit]], ids[may[hit]] = self.hash_scores[at[hit]], self.hash_ids[at[hit]]
                    if b == a + 1:
                        miss = ids < 0
                        score[miss] = width[a][miss]
                    elif not (ids >= 0).any():
                        continue
                    edge[a, b], edge_id[a, b] = score, ids
        best, come = np.full((n + 1, k), -np.inf), np.zeros((n + 1, k), np.int32)
        best[0] = 0
        for (a, b), score in sorted(edge.items()):
            new = best[a] + score
            won = new > best[b]
            best[b][won], come[b][won] = new[won], a
        back = np.full((n + 1, k), -np.inf)
        back[n] = 0
        for (a, b), score in sorted(edge.items(), reverse=True):
            np.maximum(back[a], score + back[b], out=back[a])
        # Mark the positions on the best path, from the end.
        on, at = np.zeros((n + 1, k), bool), np.full(k, n)
        rows = np.arange(k)
        while True:
            on[at, rows] = True
            if not at.any():
                break
            at = np.where(at > 0, come[at, rows], 0)
        other = np.full(k, -np.inf)
        ids_at = np.full((n, k), -1, np.int32)
        for (a, b), score in edge.items():
            used = on[b] & (come[b] == a) & on[a]
            np.maximum(other, np.where(used, -np.inf, best[a] + score + back[b]), out=other)
            ids_at[a][used] = edge_id[a, b][used]
        # Ids of all best paths one after another, cut by segment; byte pieces are put in where there is no piece.
        which, place = np.nonzero(on[:n].T)
        ids = ids_at[place, which]
        ends = np.cumsum(np.bincount(which, minlength=k)).tolist()
        bare = set(which[ids < 0].tolist())
        flat, at = ids.tolist(), 0
        for j, (end, score, loss) in enumerate(zip(ends, best[n].tolist(), (best[n] - other).tolist(), strict=True)):
            own = flat[at:end]
            if j in bare:
                own = [i for a, x in zip(place[at:end].tolist(), own, strict=True) for i in ([x] if x >= 0 else [self.byte_id[y] for y in group[j][a].encode("utf-8", "surrogatepass")])]
            yield score, tuple(own), loss
            at = end

    # -- whole texts ---------------------------------------------------------------

    @staticmethod
    def _pair(c: np.ndarray) -> np.ndarray:
        return (c[:-1] * np.uint64(40_503) + c[1:] * np.uint64(7)) & np.uint64(0x3FFFFF)

    def cut(self, text: str) -> list[str]:
        """Segments of the text with a blank in front; none of an empty text."""
        if not text:
            return []
        text = BLANK + text.replace(" ", BLANK)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        at = [0, *(np.flatnonzero(~self.joined[self._pair(codes)]) + 1).tolist(), len(text)]
        return [text[a:b] for a, b in zip(at, at[1:], strict=False)]

    def nbest(self, segments: list[str], scores: np.ndarray, losses: np.ndarray, best_ids, n: int) -> list[tuple[float, dict[int, tuple]]]:
        """The n best (score, {segment number: ids that differ from its best}) of a text; best_ids(k) gives those of a segment."""
        total = float(scores.sum())
        near = np.flatnonzero(losses <= np.partition(losses, n - 2)[n - 2]) if len(losses) >= n > 1 else np.arange(len(losses) if n > 1 else 0)
        near = sorted(k for k in near[np.argsort(losses[near], kind="stable")][: n - 1] if np.isfinite(losses[k]))
        out: list[tuple[float, dict[int, tuple]]] = [(0.0, {})]
        for k in map(int, near):
            s, first = segments[k], best_ids(k)
            options = [(0.0, None)] + [(float(scores[k]) - score, ids) for score, ids in self.a_star(s, n + 1) if ids != first]
            both = [(loss + more, kept, ids) for loss, kept in out for more, ids in options]
            both.sort(key=lambda x: x[0])
            out = [(loss, kept if ids is None else kept | {k: ids}) for loss, kept, ids in both[:n]]
        return [(total - loss, kept) for loss, kept in out[:n]]

    def encode(self, text: str, n: int = 1) -> list[tuple[float, list[int]]]:
        """The n best (score, ids) of one text."""
        segments = self.cut(text)
        solved = self.solve(list(dict.fromkeys(segments)))
        own = [solved[s] for s in segments]
        best = self.nbest(segments, np.array([x[0] for x in own]), np.array([x[2] for x in own]), lambda k: own[k][1], n)
        return [(score, [i for k, x in enumerate(own) for i in kept.get(k, x[1])]) for score, kept in best]

    def decode_bytes(self, ids) -> bytes:
        """The pieces' UTF-8, byte pieces joined in, blanks still as ``▁``."""
        return b"".join([bytes([self.byte_of[i]]) if i in self.byte_of else self.piece[i].encode("utf-8", "surrogatepass") for i in ids])

    def decode(self, ids) -> str:
        """Text of the pieces: blanks come back, the first one goes."""
        return from_blanks(self.decode_bytes(ids)).decode("utf-8", "surrogatepass")


def from_blanks(raw: bytes) -> bytes:
    return raw.replace(BLANK.encode(), b" ")[1:]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _segmentations(batches, lattice: Lattice, n: int):
    """doc_id, text, scores and ids of the n best of each text, batch by batch."""
    number: dict[str, int] = {}  # of each distinct segment, for the columns that follow
    scores, losses, sizes = np.empty(0), np.empty(0), np.empty(0, np.int64)
    ids_of, raw = [], []
    for b in slices(batches):
        texts = [t or "" for t in b.column("text").to_pylist()]
        cut = [lattice.cut(t) for t in texts]
        if len(number) > 200_000:
            number, scores, losses, sizes, ids_of, raw = {}, scores[:0], losses[:0], sizes[:0], [], []
        new = lattice.solve(list({s for segments in cut for s in segments if s not in number}))
        number |= zip(new, range(len(number), len(number) + len(new)), strict=True)
        scores = np.concatenate([scores, [x[0] for x in new.values()]])
        losses = np.concatenate([losses, [x[2] for x in new.values()]])
        sizes = np.concatenate([sizes, np.array([4 * len(x[1]) for x in new.values()], np.int64)])
        ids_of += [x[1] for x in new.values()]
        raw += [np.array(x[1], "<i4").tobytes() for x in new.values()]
        out, ends_of, all_scores = [], [], []
        for segments in cut:
            own = [number[s] for s in segments]
            at = np.array(own, np.int64)
            best = lattice.nbest(segments, scores[at], losses[at], lambda k, own=own: ids_of[own[k]], n)
            ids, ends = memoryview(b"".join([raw[k] for k in own])), None
            for _, kept in best:
                parts, last = [], 0
                if kept and ends is None:
                    ends = np.cumsum(sizes[at])
                for k, other in sorted(kept.items()):
                    parts += [ids[last : int(ends[k] - sizes[own[k]])], np.array(other, "<i4").tobytes()]
                    last = int(ends[k])
                out += [*parts, ids[last:]]
                ends_of.append(sum(map(len, parts)) // 4 + (len(ids) - last) // 4)
            all_scores.append([s for s, _ in best])
        flat = pa.array(np.frombuffer(b"".join(out), "<i4"))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *ends_of]), pa.int32()), flat)
        many = pa.array(np.cumsum([0, *map(len, all_scores)]), pa.int32())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(all_scores, pa.list_(pa.float64())), pa.ListArray.from_arrays(many, lists)], names=["doc_id", "text", "nbest_scores", "nbest_ids"])


def _decoder(lattice: Lattice):
    """A function from an Arrow list<list<int>> column to one list of the hypotheses' texts (UTF-8) a row, decoded from their ids."""
    pieces = pa.array([bytes([lattice.byte_of[i]]) if i in lattice.byte_of else p.encode("utf-8", "surrogatepass") for i, p in enumerate(lattice.piece)], pa.large_binary())

    def decode(column) -> list[list[bytes]]:
        lists = column.flatten()
        ids = lists.flatten()
        got = pieces.take(ids)
        place = np.frombuffer(got.buffers()[1], np.int64)[got.offset :][: len(got) + 1] if len(got) else np.zeros(1, np.int64)
        data = memoryview(got.buffers()[2]) if len(got) else memoryview(b"")
        ends = np.cumsum([0, *lists.value_lengths().to_pylist()])
        at = place[ends].tolist()
        texts, last, text = [], None, b""
        for a, b in zip(at, at[1:], strict=False):
            raw = bytes(data[a:b])
            if raw != last:  # hypotheses of one text mostly decode alike
                last, text = raw, from_blanks(raw)
            texts.append(text)
        out, k = [], 0
        for size in column.value_lengths().to_pylist():
            out.append(texts[k : k + size])
            k += size
        return out

    return decode


def nbest_ids(docs: DataFrame, n: int = 4, model: str | None = None) -> DataFrame:
    """Per document the n best segmentations: doc_id, text (as given), nbest_scores and nbest_ids (piece ids of each), best first."""
    model = model or default_model()
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _segmentations(batches, Lattice(model), n), "doc_id long, text string, nbest_scores array<double>, nbest_ids array<array<int>>")


def decoded(segmented: DataFrame, model: str | None = None) -> DataFrame:
    """The text of every hypothesis of ``nbest_ids``, from its ids alone: doc_id, decoded (array of texts, best first)."""
    model = model or default_model()

    def work(batches):
        decode = _decoder(Lattice(model))
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(decode(b.column("nbest_ids")), pa.list_(pa.binary())).cast(pa.list_(pa.string()))], names=["doc_id", "decoded"])

    return segmented.select("doc_id", "nbest_ids").mapInArrow(work, "doc_id long, decoded array<string>")


def nbest_digests(docs: DataFrame, n: int = 4, model: str | None = None) -> DataFrame:
    """Digests of what ``nbest_ids`` and ``decoded`` return, read off their batches: pieces and score of the best segmentation, the scores of the n best, a crc32 of each one's ids, and the decoded text's digest.

    Columns: doc_id, n_pieces, best_score, nbest_scores and nbest_crc32 (arrays of at most
    n), decoded_sha256, exact (every hypothesis decodes to the text, its ``▁`` read as a blank).
    """
    model = model or default_model()
    names = ["doc_id", "n_pieces", "best_score", "nbest_scores", "nbest_crc32", "decoded_sha256", "exact"]
    types = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.string(), pa.bool_()]
    schema = "doc_id long, n_pieces long, best_score double, nbest_scores array<double>, nbest_crc32 array<long>, decoded_sha256 string, exact boolean"

    def work(batches):
        lattice = Lattice(model)
        decode = _decoder(lattice)
        for b in _segmentations(batches, lattice, n):
            rows, k = [], 0
            lists = b.column("nbest_ids").flatten()
            ids = memoryview(lists.flatten().to_numpy().astype("<u4")).cast("B") if len(lists.flatten()) else memoryview(b"")
            ends = np.cumsum([0, *lists.value_lengths().to_pylist()]).tolist()
            given = [(t or "").replace(BLANK, " ").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            for i, t, s, whole in zip(b.column("doc_id").to_pylist(), given, b.column("nbest_scores").to_pylist(), decode(b.column("nbest_ids")), strict=True):
                own = ends[k : k + len(s) + 1]
                k += len(s)
                crcs = [zlib.crc32(ids[4 * x : 4 * y]) for x, y in zip(own, own[1:], strict=False)]
                rows.append((i, own[1] - own[0], s[0], s, crcs, hashlib.sha256(whole[0]).hexdigest(), all(x == t for x in whole)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(work, schema)
