"""Running sums, places and next values over ordered groups of any size.

A window over a group passes it through one task. Here rows are dealt by range of (group, order), so a group lies in
as many parts as it needs; windows run inside a part, and what a part takes over from those before or after it comes from one
row for each group and part.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybreak.tables import remove, stored


def split_by_size(rows: DataFrame, keys: list[str], most: int, weight: Column | None = None, heaviest: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups of up to `most` rows and a weight of up to `heaviest`, and those of larger groups, None where there is no such group."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.sum(F.lit(0) if weight is None else weight).alias("n_weight"))
    large = sizes.where((F.col("n_rows") > most) | (F.col("n_weight") > heaviest)).select(*keys)
    if large.isEmpty():
        return rows, None
    return joined(rows, large, keys, "left_anti"), joined(rows, large, keys, "left_semi")


def laid_out(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows in a stored table, in order, with their part and their seat, which ascends with the order."""
    columns = [*keys, *order]
    seated = rows.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("seat", F.monotonically_increasing_id())
    return stored(seated.withColumn("part", F.shiftright("seat", 33)), "ordered")


def joined(left: DataFrame, right: DataFrame, on: Mapping[str, str] | list[str], how: str = "inner") -> DataFrame:
    """The rows of left beside those of right whose columns equal theirs, nulls included; right's columns of `on` are left out.

    on: names, or left's names and right's. Other columns of the two don't share names.
    """
    pairs = dict(on) if isinstance(on, Mapping) else {c: c for c in on}
    mine = {r: f"{r}__right" for r in pairs.values()}
    other = right.select(*(F.col(c).alias(mine.get(c, c)) for c in right.columns))
    same = reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(mine[b])) for a, b in pairs.items()])
    out = left.join(other, same, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*mine.values())


def running(laid: DataFrame, keys: list[str], values: Mapping[str, Column]) -> DataFrame:
    """The rows with sums of the values over their group up to and with themselves, by name."""
    here = Window.partitionBy(*keys, "part").orderBy("seat").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = laid.groupBy(*keys, "part").agg(*(F.sum(v).alias(f"{n}_part") for n, v in values.items()))
    before = sums.select(*keys, "part", *(F.coalesce(F.sum(f"{n}_part").over(earlier), F.lit(0)).alias(f"{n}_before") for n in values))
    inner = laid.withColumns({n: F.sum(v).over(here) for n, v in values.items()})
    return joined(inner, before, [*keys, "part"], "left").withColumns({n: F.col(n) + F.col(f"{n}_before") for n in values}).drop(*(f"{n}_before" for n in values))


def next_value(laid: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The rows with their group's first value that isn't null from themselves on; null after the last one."""
    # read backwards: Spark adds up a frame that grows with the rows, and takes one that shrinks anew for each row
    here = Window.partitionBy(*keys, "part").orderBy(F.desc("seat")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy(*keys).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = laid.groupBy(*keys, "part").agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col("seat"))).alias("first_here"))
    beyond = firsts.select(*keys, "part", F.last("first_here", ignorenulls=True).over(later).alias("first_beyond"))
    inner = laid.withColumn(name, F.last(value, ignorenulls=True).over(here))
    return joined(inner, beyond, [*keys, "part"], "left").withColumn(name, F.coalesce(name, "first_beyond")).drop("first_beyond")


def places(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """The rows with their place in their group's order, from 0."""
    counted = running(laid_out(rows, keys, order), keys, {name: F.lit(1).cast("long")})
    return counted.withColumn(name, F.col(name) - 1).drop("part", "seat")


def chains(starts: DataFrame, jumps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, b, j): every place b of a group that jumps (keys, b, next) lead to from its starts (keys, b), and after how many of them.

    jumps is a stored table, which goes. A round reaches four times as many jumps as the one before; it ends when no jump of its length is left.
    """
    same = {k: k for k in keys}
    reached, reach = starts.withColumn("j", F.lit(0).cast("long")), 1
    while not jumps.isEmpty():
        twice = _jumped(jumps, jumps, same)
        for step, table in ((reach, jumps), (2 * reach, twice)):
            further = joined(reached, table, same | {"b": "b"}).select(*keys, F.col("next").alias("b"), (F.col("j") + step).alias("j"))
            reached = reached.unionByName(further)
        reached = stored(reached, "reached")
        longer = stored(_jumped(twice, twice, same), "jumps")
        remove(jumps)
        jumps, reach = longer, 4 * reach
    return reached


def _jumped(first: DataFrame, second: DataFrame, same: Mapping[str, str]) -> DataFrame:
    to = second.select(*same, F.col("b").alias("at"), F.col("next").alias("over"))
    return joined(first, to, same | {"next": "at"}).select(*same, "b", F.col("over").alias("next"))
