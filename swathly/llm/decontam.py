"""Benchmark decontamination: prefix-filtered set join of documents and item windows. DataFrame functions only.

A window is ``WINDOW`` consecutive words of an item (all words of a shorter one). Windows
and documents are sets of word shingles of ``SHINGLE`` words (or of all words of a
shorter window). Shingles are ordered by rarity, counted over all documents. Because a
window has to be contained whole, its necessary prefix is its single rarest shingle: a
document can hold the window only where it holds that shingle. Where it does, the
shingle's place in the window fixes where the window would start; starts before the
document's first word or too near its end are dropped (positional and length bounds),
and the words themselves are compared.

The documents are read twice. First, shingle hashes meet the distinct shingles of the
benchmark (broadcast only when counted to be at most ``BROADCAST_ROWS``, else by a
shuffled join); what is left, hits, is written out, counted, and joined with the
prefixes. (Counting first and joining the prefixes in another pass over the texts would
cut every text into shingles once more, which is the dearest step by far; the hits are
few.) Then each document meets its own candidates by key and is verified row by row: no
group is larger than one document. Candidates carry a window's number; the items that hold
it are joined once, after verification, so a window that many items share costs no more.

Defined cases: a null or empty text has no words, hence no hits; null items and items
without words are never found; repeated items with one id count once, null item ids are
ignored; repeated documents are judged row by row; an empty benchmark leaves every
document clean; an empty table gives no rows; other columns are ignored, and kept by
``drop_contaminated`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, discard, free_names, materialize, row_key

WINDOW, SHINGLE, MIN_ITEMS = 8, 4, 2
BROADCAST_ROWS = 200_000
#: Everything but words, for texts whose A-Z are lower-cased already.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text; a null has none."""
    found = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP)
    return F.filter(found, lambda w: w != "")


def _hashes(w: Column, size: Column | int) -> Column:
    """A hash of each run of ``size`` words, in order; the size takes part in it."""
    last = F.size(w) - (F.lit(size) if isinstance(size, int) else size)
    n = F.lit(size) if isinstance(size, int) else size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(F.slice(w, i, n)))).otherwise(F.array().cast("array<bigint>"))


def item_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """number, window (words), size of the distinct windows; and number, item of the items that hold each. Both written."""
    w = benchmark.where("item_id is not null").select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(WINDOW))
    each = w.select(F.col("item_id").cast("string").alias("item"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))).alias("window"))
    windows = materialize(each.select("window").distinct().select(F.monotonically_increasing_id().alias("number"), "window", F.size("window").alias("size")), "windows")
    return windows, materialize(each.join(windows, "window").select("number", "item").distinct(), "holders")


def hits(docs: DataFrame, shingles: DataFrame, sizes: list[int], small: bool) -> DataFrame:
    """key, pos (from 0), h: where documents hold a shingle of the benchmark."""
    w = docs.select(row_key().alias("key"), words(F.col("text")).alias("w"))
    parts = [F.transform(_hashes(F.col("w"), s), lambda h, i: F.struct(i.alias("pos"), h.alias("h"))) for s in sizes]
    each = w.select("key", F.explode(parts[0] if len(parts) == 1 else F.concat(*parts)).alias("s")).select("key", "s.pos", "s.h")
    return each.join(F.broadcast(shingles) if small else shingles, "h", "left_semi")


def contamination(docs: DataFrame, benchmark: DataFrame, min_items: int = MIN_ITEMS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest (words of its longest window found), and the row's key."""
    windows, holders = item_windows(benchmark)
    size = F.least(F.col("size"), F.lit(SHINGLE))
    inside = F.transform(_hashes(F.col("window"), size), lambda h, i: F.struct(h.alias("h"), i.alias("at")))
    each = windows.withColumn("s", F.explode(inside)).select("number", "s.h", "s.at")
    shingles = each.select("h").distinct()
    sizes = [r[0] for r in windows.select(size.alias("n")).distinct().orderBy("n").collect()]  # at most SHINGLE numbers
    if not sizes:
        sizes = [SHINGLE]
    small = shingles.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = materialize(hits(docs.select("doc_id", "text"), shingles, sizes, small), "hits")
    rarity = found.groupBy("h").agg(F.count("*").alias("n"))
    # A window with a shingle that no document holds drops out; the rarest of the others is its prefix.
    rare = each.join(rarity, "h", "left").groupBy("number").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("h"), F.col("at"))).alias("p"))
    prefix = rare.where("p.n > 0").select("number", F.col("p.h").alias("h"), F.col("p.at").alias("at")).join(windows, "number")
    start = F.col("pos") - F.col("at")
    candidates = found.join(prefix, "h").where(start >= 0).select("key", F.struct(start.alias("start"), "size", "window", "number").alias("c")).distinct()
    per_doc = candidates.groupBy("key").agg(F.collect_list("c").alias("cs"))
    w = F.col("w")
    # Texts go through the shuffle as they are and are cut into words behind it: word arrays take several times their room.
    own = docs.select("doc_id", row_key().alias("key"), "text").join(per_doc, "key", "left").select("doc_id", "key", "cs", words(F.col("text")).alias("w"))
    true = F.filter(F.coalesce(F.col("cs"), F.array()), lambda c: (c["start"] + c["size"] <= F.size(w)) & (F.slice(w, c["start"] + 1, c["size"]) == c["window"]))
    out = own.select("doc_id", "key", F.size(w).cast("long").alias("n_words"), true.alias("v"))
    places = F.array_distinct(F.flatten(F.transform("v", lambda c: F.sequence(c["start"], c["start"] + c["size"] - 1))))
    longest = F.coalesce(F.array_max(F.transform("v", lambda c: c["size"])), F.lit(0))
    judged = materialize(out.select("doc_id", "key", "n_words", F.size(places).cast("long").alias("n_hit"), longest.alias("longest"), F.array_distinct(F.transform("v", lambda c: c["number"])).alias("numbers")), "judged")
    items = judged.select("key", F.explode("numbers").alias("number")).distinct().join(holders, "number").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("i"))
    i = F.coalesce("i", F.array().cast("array<string>"))
    result = judged.join(items, "key", "left").select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(i).cast("long").alias("n_items"),
        F.sha2(F.array_join(i, ","), 256).alias("items_sha256"),
        (F.size(i) >= min_items).alias("contaminated"),
        "longest",
        "key",
    )
    discard(windows, found)
    return result


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_items: int = MIN_ITEMS) -> DataFrame:
    """The clean documents, columns as they were.

    A document goes if it holds a full window of ``WINDOW`` words of any item, or windows of
    ``min_items`` items where these are shorter: one short item alone may be everyday words.
    """
    judged = contamination(docs, benchmark, min_items)
    (own,) = free_names(docs, "row_key")
    bad = judged.where(F.col("contaminated") | (F.col("longest") >= WINDOW)).select(F.col("key").alias(own)).distinct()
    return docs.withColumn(own, row_key()).join(bad, own, "left_anti").drop(own)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') AS win
  FROM b, unnest(range(1, len(w) - least(len(w), 8) + 2)) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) t(i) WHERE len(w) >= n),
m AS (SELECT dw.rid, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM m, unnest(range(i, i + n)) t(p) GROUP BY rid),
k AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN k USING (rid)
"""
