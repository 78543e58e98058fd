"""Exact ranks and running sums of groups of any size.

A window over a year or a model puts all its rows into one task. Here rows are dealt out by range over group and
order, each range is summed by itself, the sums of the ranges before are added from a table of about one row for
each range, and no task holds more than a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.sources.scratch import saved

#: Rows of sums (one for each range and group) that are broadcast; more are joined by a shuffle.
BROADCAST = 100_000


def running(df: DataFrame, by: list[str], order: list[Column | str], sums: list[str]) -> DataFrame:
    """``df`` with <name>_upto (sum in order, the row included) and <name>_all (of the group) for each of ``sums``.

    The order must tell rows apart for results that repeat. Null groups are groups. The ranges are written once, as
    their bounds come from a sample that another evaluation could draw differently.
    """
    ranged = saved(df.repartitionByRange(*(F.col(c) for c in by), *(F.col(c) if isinstance(c, str) else c for c in order)).withColumn("_range", F.spark_partition_id()), "ranges")
    parts = ranged.groupBy("_range", *by).agg(*(F.sum(c).alias(f"_sum_{c}") for c in sums))
    before, group = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*by)
    parts = parts.select("_range", *by, *(F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in sums), *(F.sum(f"_sum_{c}").over(group).alias(f"{c}_all") for c in sums))
    parts = saved(parts, "range-sums")
    parts = F.broadcast(parts) if parts.count() <= BROADCAST else parts
    same = F.col("a._range") == F.col("b._range")
    for c in by:
        same = same & F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`"))
    joined = ranged.alias("a").join(parts.alias("b"), same)
    joined = joined.select("a.*", *(f"b._before_{c}" for c in sums), *(f"b.{c}_all" for c in sums))
    inside = W.partitionBy("_range", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = joined.withColumns({f"{c}_upto": F.col(f"_before_{c}") + F.sum(c).over(inside) for c in sums})
    return out.drop("_range", *(f"_before_{c}" for c in sums))


def row_numbers(df: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """``df`` with row_no (from 1) and group_rows."""
    return running(df.withColumn("_one", F.lit(1).cast("long")), by, order, ["_one"]).withColumnsRenamed({"_one_upto": "row_no", "_one_all": "group_rows"}).drop("_one")


def tile(row_no: Column, rows: Column, n: int) -> Column:
    """The tile of a row among n tiles whose sizes differ by one at most, larger ones first."""
    size, larger = F.floor(rows / n), rows % n
    head = larger * (size + 1)
    return F.when(row_no <= head, F.ceil(row_no / (size + 1))).otherwise(larger + F.ceil((row_no - head) / F.greatest(size, F.lit(1)))).cast("int")


def null_safe(a: DataFrame, b: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    """a joined to b on columns of which nulls are equal, with a's copies of them."""
    on = F.lit(True)
    for c in by:
        on = on & F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`"))
    return a.alias("a").join(b.alias("b"), on, how).select("a.*", *(f"b.`{c}`" for c in b.columns if c not in by))


def quantiles(df: DataFrame, by: list[str], value: str, at: dict[str, float], discrete: bool = False) -> DataFrame:
    """(by, a column for each name of ``at``): exact quantiles of the values that are not null, for groups of any size.

    Values are counted first, distinct ones are dealt out by range, and each quantile is picked by its rank: the
    linear interpolation between two ranks, or with ``discrete`` the first value that reaches the share. Groups without
    values are left out.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranked = running(counts, by, [value], ["_n"])
    below = F.col("_n_upto") - F.col("_n")

    def value_at(rank: Column) -> Column:
        return F.max(F.when((below <= rank) & (rank < F.col("_n_upto")), F.col(value)))

    picks = {}
    for name, q in at.items():
        if discrete:
            picks[name] = value_at(F.greatest(F.ceil(F.lit(q) * F.col("_n_all")) - 1, F.lit(0)))
            continue
        place = F.lit(q) * (F.col("_n_all") - 1)
        low, share = value_at(F.floor(place)), F.max(place - F.floor(place))
        picks[name] = F.when(share > 0, low + (value_at(F.ceil(place)) - low) * share).otherwise(low)
    return ranked.groupBy(*by).agg(*(c.alias(n) for n, c in picks.items()))
