"""Global order without a global partition: row numbers, running sums and exact quantiles of any length.

Rows are dealt to ranges of the order, written once with the number of their range, and
counted per range. Only one number per range meets in one place (on the driver, or in a
window over ranges), never the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def _dealt(df: DataFrame, order: list, tag: str) -> DataFrame:
    """The written rows with ``__p``, the number of their range: all rows of one come before those of the next."""
    return materialize(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), tag)


def with_group(df: DataFrame, per: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns of their group, null keys matched too; without keys ``per`` is a single row."""
    if not keys:
        return df.join(F.broadcast(per))  # one row
    named = per.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in per.columns if c not in keys])
    on = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        on = one if on is None else on & one
    return df.join(named, on).drop(*[f"__k_{k}" for k in keys])


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """The rows with their number (from 1) in a total ``order``, as a long column. Equal rows are numbered in any order."""
    own = _dealt(df, order, "numbered")
    before = F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = own.groupBy("__p").agg(F.count("*").alias("n")).select("__p", before.alias("__b"))  # one row per range
    n = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return own.withColumn(name, n).join(starts, "__p").withColumn(name, F.col(name) + F.col("__b")).drop("__p", "__b")


def running_sum(df: DataFrame, number: str, value: Column, name: str, per: int = 100_000) -> DataFrame:
    """Sum of ``value`` over all rows up to each, in the order of a row number: by blocks of ``per`` rows, whose totals are carried."""
    own = df.withColumn("__b", F.floor((F.col(number) - 1) / per)).withColumn(name, value)
    before = F.coalesce(F.sum("t").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = own.groupBy("__b").agg(F.sum(name).alias("t")).select("__b", before.alias("__c"))  # one row per block
    inside = F.sum(name).over(Window.partitionBy("__b").orderBy(number).rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn(name, inside).join(totals, "__b").withColumn(name, F.col(name) + F.col("__c")).drop("__b", "__c")


def previous(df: DataFrame, number: str, values: list[str], prefix: str = "p_") -> DataFrame:
    """The values of the row before, by an equi-join on the row number; null at the first row."""
    back = df.select((F.col(number) + 1).alias(number), *[F.col(v).alias(prefix + v) for v in values])
    return df.join(back, number, "left")


def ranked_percentiles(df: DataFrame, value: str, ps: tuple[float, ...], keys: list[str] = ()) -> DataFrame:
    """keys, p_0, p_1, ...: exact, linearly interpolated percentiles; nulls don't count, a key without values gets nulls.

    Distinct values are counted (with sums per task before the shuffle) and dealt to ranges of
    (keys, value); the counts before each range and key give every value its ranks. No task
    holds the values of a key, however many rows or values it has.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    own = _dealt(counts, [*keys, "__v"], "ranks")
    some = own.where("__v is not null")
    per = some.groupBy(*keys, "__p").agg(F.sum("__n").alias("n"))
    w = Window.partitionBy(*keys)
    per = per.withColumn("__before", F.coalesce(F.sum("n").over(w.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__total", F.sum("n").over(w)).drop("n")  # one row per key and range
    upto = F.sum("__n").over(Window.partitionBy("__p", *keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    hi = F.col("__upto") + F.col("__before")
    both = with_group(some.withColumn("__upto", upto), per, [*keys, "__p"]).select(*keys, "__v", hi.alias("hi"), (hi - F.col("__n")).alias("lo"), F.col("__total").alias("n"))
    picks = []
    for k, p in enumerate(ps):
        at = F.col("n").cast("double") - 1
        place = F.lit(float(p)) * at
        for name, rank in (("f", F.floor(place)), ("c", F.ceil(place))):
            picks.append(F.max(F.when((F.col("lo") <= rank) & (rank < F.col("hi")), F.col("__v"))).alias(f"__{name}{k}"))
    got = both.groupBy(*keys).agg(F.max("n").alias("__n"), *picks)
    out = []
    for k, p in enumerate(ps):
        place = F.lit(float(p)) * (F.col("__n").cast("double") - 1)
        out.append((F.col(f"__f{k}") + (F.col(f"__c{k}") - F.col(f"__f{k}")) * (place - F.floor(place))).alias(f"p_{k}"))
    found = got.select(*keys, *out)
    if not keys:
        return found
    every = own.select(*keys).distinct().select(*[F.col(k).alias(f"__e_{k}") for k in keys])
    on = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"__e_{k}"))
        on = one if on is None else on & one
    return every.join(found, on, "left").select(*[F.col(f"__e_{k}").alias(k) for k in keys], *[f"p_{k}" for k in range(len(ps))])
