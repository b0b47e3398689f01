"""Secret scans: base patterns plus a guess-cost model for values in a credential context.

Base spans are regular-expression matches. The method prices every value that follows a
credential word, whether or not a base span touches it: a dynamic program finds the
cheapest segmentation into dictionary words, dates, repeats, keyboard walks and
brute-force spans. A value whose price reaches ``min_log10`` is added as a ``guess`` span;
base spans stay. Each value is returned with its price and segmentation.

The dictionary has common words of passwords first, then the corpus's own words by the
number of documents that hold them (``fit_words``: a grouped count over all documents, of
which the ``VOCABULARY`` most frequent are kept, a documented bound). Words that stand as
values in a credential context are not counted, so a secret with many copies does not
become a word.

A context needs a left boundary ("bypass:" is none). Behind "is", where prose may follow,
a value that holds no digit, sign or capital inside is priced, too, but never added.

Defined cases: a null text counts as empty; an empty text has no spans (counts 0,
empty string, digest of the empty string, no values); null or repeated ids pass through row
by row; an empty table gives no rows and the fixed words alone; other columns are ignored.
Offsets are code points, ends exclusive. The work per text is linear in its length.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: A maximal run of 20+ (24+) characters is what the plain pattern with a later length test leaves.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A credential word, at the start of a word (or of its part in camel case), and its separator, up to where the value or its quote begins.
CONTEXT = re.compile(
    r"""(?:(?<![a-z])|(?-i:(?<=[a-z])(?=[A-Z])))(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|auth(?:orization)?|credentials?|private[_-]?key)["']?[\x20\t]*(:|=>?|\x20is\x20)[\x20\t]*""",
    re.I | re.A,
)
#: What prose has none of: a digit, a sign before the value's end, or a capital behind its first letter.
MARKED = re.compile(r"\d|[^\w\s].*\w|.+[A-Z]", re.A | re.S)
#: A value in quotes ends at the matching one on its line, escaped ones stepped over; only without any match a quote is skipped.
QUOTED = re.compile(r""""((?:\\.|[^"\\\r\n])+)"|'((?:\\.|[^'\\\r\n])+)'|"([^"\r\n]+)"|'([^'\r\n]+)'""")
#: A value without quotes ends at a blank, quote, < or >, and at a comma or semicolon behind which another name and separator, a blank or nothing comes.
BARE = re.compile(r"""["']?((?:[^\s"'<>,;]|[,;](?![\s"'<>,;]|\Z|[\w.-]+["']?[\x20\t]*[:=]))+)""", re.A)
ASSIGN_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
CONTEXT_HINTS = (b"pass", b"pwd", b"secret", b"token", b"key", b"auth", b"credential")
KINDS = ("assign", "access", "hex", "guess")

#: Very common words of passwords, most frequent first.
WORDS = (
    "password 123456 qwerty admin welcome letmein monkey dragon master login abc123 iloveyou sunshine princess football "
    "secret test guest root user pass changeme default example sample demo shadow summer winter spring autumn love hello "
    "freedom whatever trustno1 computer internet service server access token key database mysql oracle company office "
    "baseball superman batman michael jordan jennifer hunter ranger buster soccer hockey george charlie andrew thomas "
    "the and for you not with this that from your please none null true false redacted removed placeholder insert here xxx"
).split()
WORD_RANK = {w: i + 1 for i, w in enumerate(WORDS)}
#: Words of the corpus: letters only; how many of them the dictionary takes; counts that a task holds at once.
LETTERS = re.compile(r"[^\W\d_]{3,24}")
VOCABULARY, HELD = 20_000, 400_000
LONGEST_WORD = 24
#: Letters that digits and signs commonly stand for.
LEET = str.maketrans("@4310$57", "aaeiosst")
#: Rows of a keyboard and the alphabet, along which walks run.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
NEXT_KEYS = {r[i : i + 2] for r in ROWS for i in range(len(r) - 1)} | {r[i + 1] + r[i] for r in ROWS for i in range(len(r) - 1)}
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d")
YEAR = re.compile(r"(?:19|20)\d\d")
OPEN = math.log10(2)
DATE_COST, YEAR_COST = math.log10(365 * 120), math.log10(120)
MIN_RUN = 3
PERIODS = (1, 2, 3, 4)


def _char_cost(c: str) -> float:
    if c.isdigit() and c.isascii():
        return 1.0
    if c.isascii() and c.isalpha():
        return math.log10(26)
    return math.log10(33) if c.isascii() else math.log10(500)


def segment(value: str, ranks: Mapping[str, int] = WORD_RANK) -> tuple[float, list[tuple[int, int, str]]]:
    """log10 of the guesses that the cheapest segmentation of ``value`` needs, and its parts (start, end, kind); 0 and none for the empty value.

    Costs add up over spans, each span pays ``OPEN`` besides its own price. Repeats and walks
    may start and end anywhere within their longest run. Their price grows with the logarithm of
    their length, so a start that has once lost to an earlier one never wins again, nor does one
    before a later start that costs no more. The few starts that are left keep the program
    near linear in the length.
    """
    n = len(value)
    low = value.lower() if len(value.lower()) == n else value
    plain = low.translate(LEET)
    best, brute, brute_from = [math.inf] * (n + 1), [math.inf] * (n + 1), [0] * (n + 1)
    come: list[tuple[int, str]] = [(0, "")] * (n + 1)
    best[0] = 0.0
    jumps: dict[int, tuple[float, int, str]] = {}  # ends of long spans that began earlier
    char = [_char_cost(c) for c in value]
    #: First place of the run that reaches the current one, and (cost without length, start) of the starts in it.
    runs = {p: 0 for p in PERIODS}
    run_starts: dict[int, list[tuple[float, int]]] = {p: [] for p in PERIODS}
    walk, walk_starts = 0, []

    def reach(end: int, cost: float, start: int, kind: str) -> None:
        if end not in jumps or cost < jumps[end][0]:
            jumps[end] = (cost, start, kind)

    def cheapest(starts: list[tuple[float, int]], cost: float, start: int, end: int) -> tuple[float, int]:
        """Least cost + log10(end - start) of ``starts`` and a new one, and where it starts; those that can't win any more go."""
        while starts and starts[-1][0] >= cost:
            starts.pop()
        starts.append((cost, start))
        least, left = (math.inf, start), []
        for c, s in starts:
            if (total := c + math.log10(end - s)) < least[0]:
                least = (total, s)
                left.append((c, s))
        starts[:] = left
        return least

    for i in range(n + 1):
        options = [(best[i], *come[i]), (brute[i], brute_from[i], "brute")]
        if i in jumps:
            options.append(jumps.pop(i))
        if i >= 2 and low[i - 2 : i] not in NEXT_KEYS:
            walk, walk_starts = i - 1, []
        if (s := i - MIN_RUN) >= walk:
            options.append((*cheapest(walk_starts, best[s] + OPEN + math.log10(47 * 2), s, i), "walk"))
        for p in PERIODS:
            if i > p and value[i - 1] != value[i - 1 - p]:
                runs[p], run_starts[p] = i - p, []
            if (s := i - max(MIN_RUN, 2 * p)) >= runs[p]:
                options.append((*cheapest(run_starts[p], best[s] + OPEN + sum(char[s : s + p]) - math.log10(p), s, i), "repeat"))
        best[i], *own = min(options, key=lambda o: o[0])
        come[i] = tuple(own)
        if i == n:
            break
        here = best[i] + OPEN
        brute[i + 1], brute_from[i + 1] = min((here, i), (brute[i], brute_from[i]))
        brute[i + 1] += char[i]
        for size in range(3, min(LONGEST_WORD, n - i) + 1):
            word = low[i : i + size]
            rank, extra = ranks.get(word), 0.0
            if rank is None and (rank := ranks.get(plain[i : i + size])) is not None:
                extra = OPEN
            if rank is not None:
                extra += OPEN * (value[i : i + size] != word)
                reach(i + size, here + math.log10(rank + 1) + extra, i, "word")
        if value[i].isdigit():
            if m := DATE.match(value, i):
                reach(m.end(), here + DATE_COST, i, "date")
            if m := YEAR.match(value, i):
                reach(m.end(), here + YEAR_COST, i, "date")
    parts, at = [], n
    while at:
        start, kind = come[at]
        parts.append((start, at, kind))
        at = start
    return best[n], parts[::-1]


def guess_cost(value: str, ranks: Mapping[str, int] = WORD_RANK) -> float:
    return segment(value, ranks)[0]


def values(text: str):
    """(start, end, separator) of the values in a credential context; none that lies within the one before.

    Such an inner value is a part of what the outer value's price covers. A plain word behind
    "is" is prose and covers nothing.
    """
    last = 0
    for m in CONTEXT.finditer(text):
        if m.end() < last:
            continue
        if v := QUOTED.match(text, m.end()) or BARE.match(text, m.end()):
            start, end = v.span(v.lastindex)
            yield start, end, m[1]
            if m[1][0] in ":=" or MARKED.search(text, start, end):
                last = end


class Scanner:
    """Spans and prices under one dictionary; remembers what short values cost."""

    def __init__(self, ranks: Mapping[str, int] = WORD_RANK, min_log10: float = 8.0):
        self.ranks, self.min_log10, self.memo = ranks, min_log10, {}

    def price(self, value: str) -> tuple[float, list[tuple[int, int, str]]]:
        if len(value) > 256:
            return segment(value, self.ranks)
        if value not in self.memo:
            if len(self.memo) >= 100_000:
                self.memo.clear()
            self.memo[value] = segment(value, self.ranks)
        return self.memo[value]

    def priced(self, text: str) -> list[dict]:
        """start, end, log10_guesses, strong and parts (start, end, kind; of the text) of each value in a credential context."""
        out = []
        for s, e, sign in values(text):
            cost, parts = self.price(text[s:e])
            strong = cost >= self.min_log10 and (sign[0] in ":=" or bool(MARKED.search(text, s, e)))
            out.append({"start": s, "end": e, "log10_guesses": round(cost, 6), "strong": strong, "parts": [{"start": s + a, "end": s + b, "kind": k} for a, b, k in parts]})
        return out

    def scan(self, text: str) -> tuple[list[tuple[int, int, str]], list[dict]]:
        """Spans (start, end, kind), by start, then kind as listed; and the priced values."""
        raw = text.encode("utf-8", "surrogatepass")
        low = raw.lower()  # of bytes: A-Z only
        found, priced = [], []
        if any(h in low for h in ASSIGN_HINTS):
            found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        if b"AKIA" in raw:
            found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
        found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
        if any(h in low for h in CONTEXT_HINTS):
            # Also values that touch base spans: a base span may end within its value.
            priced = self.priced(text)
            found += [(v["start"], v["end"], 3) for v in priced if v["strong"]]
        return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2], x[1]))], priced


def scan(text: str, min_log10: float = 8.0, ranks: Mapping[str, int] = WORD_RANK) -> list[tuple[int, int, str]]:
    return Scanner(ranks, min_log10).scan(text)[0]


# -- the dictionary ----------------------------------------------------------------


def plain_words(text: str) -> set[str]:
    """The lower-cased words of a text, without values in a credential context."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    if any(h in raw for h in CONTEXT_HINTS):
        at, kept = 0, []
        for s, e, _ in values(text):
            kept.append(text[at:s])
            at = max(at, e)
        text = " ".join([*kept, text[at:]])
    return set(LETTERS.findall(text.lower()))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: in how many documents each word stands. Tasks add up as far as they can hold; the rest is a grouped sum."""

    def work(batches):
        counts: Counter = Counter()

        def put():
            words = sorted(counts)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[w] for w in words], pa.int64())], names=["word", "n"])

        for b in slices(batches):
            for t in b.column("text").to_pylist():
                if t:
                    counts.update(plain_words(t))
                if len(counts) > HELD:
                    yield put()
                    counts.clear()
        if counts:
            yield put()

    return docs.select("text").mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit_words(docs: DataFrame, size: int = VOCABULARY, parts: int = 4) -> dict[str, int]:
    """Rank of each dictionary word: the fixed ones, then the ``size`` most frequent words of two or more documents, by count and then the word.

    Each task keeps its own ``size`` first words, then each of ``parts`` tasks does among those, so
    the driver gets at most ``parts`` x ``size`` words, however many tasks there were.
    """
    order = [F.desc("n"), F.asc("word")]

    def first(batches):
        left = size
        for b in batches:
            if left:
                b = b.slice(0, left)
                left -= b.num_rows
                yield b

    best = word_counts(docs).where("n > 1").sortWithinPartitions(*order).mapInArrow(first, "word string, n long")
    best = best.repartition(parts).sortWithinPartitions(*order).mapInArrow(first, "word string, n long")
    top = best.orderBy(*order).limit(size).collect()
    ranks = dict(WORD_RANK)
    for r in top:
        ranks.setdefault(r.word, len(ranks) + 1)
    return ranks


# -- documents ---------------------------------------------------------------------


def mask(text: str, spans: list[tuple[int, int, str]], put: str = "[SECRET]") -> str:
    """The text with every span replaced; overlapping spans become one."""
    out, at = [], 0
    for s, e, _ in spans:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], put]
        at = e
    return "".join([*out, text[at:]])


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


VALUES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("log10_guesses", pa.float64()), ("strong", pa.bool_()), ("parts", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])))]))


def secret_spans(docs: DataFrame, min_log10: float = 8.0, ranks: Mapping[str, int] | None = None) -> DataFrame:
    """One row per document: counts of base spans, their digest, all spans, and what each value in a credential context costs, with its segmentation."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "values"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), VALUES]
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, values array<struct<start: int, end: int, log10_guesses: double, strong: boolean, parts: array<struct<start: int, end: int, kind: string>>>>"
    shared = docs.sparkSession.sparkContext.broadcast(fit_words(docs) if ranks is None else ranks)  # at most VOCABULARY words and the fixed ones

    def work(batches):
        scanner = Scanner(shared.value, min_log10)
        for b in slices(batches):
            rows = []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                spans, priced = scanner.scan(t or "")
                kinds = [k for _, _, k in spans]
                base = _joined(x for x in spans if x[2] != "guess")
                rows.append((i, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(base.encode()).hexdigest(), _joined(spans), kinds.count("guess"), priced))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(work, schema)


def mask_secrets(docs: DataFrame, min_log10: float = 8.0, ranks: Mapping[str, int] | None = None) -> DataFrame:
    """The documents with each secret replaced and ``n_chars`` brought up to date; every document stays."""
    schema = docs.schema
    shared = docs.sparkSession.sparkContext.broadcast(fit_words(docs) if ranks is None else ranks)

    def work(batches):
        scanner = Scanner(shared.value, min_log10)
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            new = [t if t is None else mask(t, scanner.scan(t)[0]) for t in texts]
            cols = {n: b.column(n) for n in b.schema.names}
            cols["text"] = pa.array(new, b.schema.field("text").type)
            if "n_chars" in cols:
                old = cols["n_chars"].to_pylist()
                cols["n_chars"] = pa.array([o if m == t else len(m) for o, t, m in zip(old, texts, new, strict=True)], b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([cols[n] for n in b.schema.names], names=b.schema.names)

    return docs.mapInArrow(work, schema)
