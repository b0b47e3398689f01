"""URL filters: host-suffix and path-prefix expressions against a rule list. DataFrame functions only.

Each URL is expanded into host suffixes (of the label counts that rules have) joined with
path prefixes (of the lengths that rules have). The expressions meet the rules in an
equi-join on the first ``PREFIX`` hex digits of their SHA-256; the full digest confirms,
and the longest rule wins (then the longer host, then block before allow).

Verdicts are worked out once per distinct URL, so a URL that many rows share is expanded
once; rows are joined back by URL. A URL without a fitting rule gets the method's default
verdict.

Defined cases: a null URL or one without ``://`` has empty host and path and the default
verdict; repeated rows and null page ids are judged row by row; an empty rule list
leaves the default everywhere; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

PREFIX = 8
#: The contract's rules: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark, rules=RULES) -> DataFrame:
    """Rules as a table: expr, digest, prefix, verdict, host_len."""
    rows = [(h + p, v, len(h)) for v, h, p in rules]
    return with_digest(spark.createDataFrame(rows, "expr string, verdict string, host_len int"))


def with_digest(df: DataFrame) -> DataFrame:
    digest = F.sha2(F.col("expr"), 256)
    return df.withColumn("digest", digest).withColumn("prefix", F.substring(digest, 1, PREFIX))


def expressions(urls: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """One row per URL and shape (labels of the host, characters of the path) that the URL is long enough for."""
    if not shapes:
        shapes = [(0, 0)]
    labels = F.when(F.col("host") == "", 0).otherwise(F.size(F.split("host", r"\.")))
    shape = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in shapes])
    fits = F.filter(shape, lambda s: (s["k"] > 0) & (s["k"] <= labels) & (s["n"] <= F.length("path")))
    wide = urls.select("url", "host", "path", F.explode(fits).alias("s"))
    # The functions take plain counts only; SQL takes columns.
    return wide.select("url", F.expr("concat(substring_index(host, '.', -s.k), substring(path, 1, s.n))").alias("expr"))


def url_verdicts(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``."""
    spark = pages.sparkSession
    table = rule_table(spark, rules)
    shapes = sorted({(h.count(".") + 1, len(p)) for _, h, p in rules})
    pages = pages.select("page_id", "url")
    distinct = pages.where("url is not null").select("url").distinct()
    parts = distinct.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    found = with_digest(expressions(parts, shapes)).alias("u").join(table.alias("r"), "prefix").where("u.digest = r.digest")
    rank = F.struct(F.length("r.expr").alias("len"), F.col("r.host_len"), (F.col("r.verdict") == "block").alias("b"), F.col("r.expr").alias("rule"), F.col("r.verdict").alias("v"))
    best = found.groupBy("u.url").agg(F.max(rank).alias("best"))
    out = pages.join(best, "url", "left")
    return out.select(
        "page_id",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.v", F.lit(default)).alias("verdict"),
    )


ORACLE = r"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r AS (SELECT * FROM (VALUES ('allow','org','/'),('block','example.org','/es/'),('block','example.org','/en/1'),('allow','com','/fr/'),('block','com','/de/')) t(verdict, rhost, rpath)),
m AS (
  SELECT p.*,
    (SELECT arg_max({'rule': rhost || rpath, 'verdict': verdict}, length(rhost || rpath)) FROM r
      WHERE (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)) AS best
  FROM p)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM m
"""
