"""Exact order statistics of groups by histograms that close in on the ranks.

Values fall into cells that depend on nothing but the value: steps of the logarithm of its size, nested from round to round. Cells
are counted before they move, and groups that overlap, such as circular windows, add up cells in place of copies of the samples.
Each round keeps the cells that hold a wanted rank, and another follows while these hold more values on average than a round has
cells for, that is, while counting cells moves fewer rows than the values would. Then the values in those cells are counted, equal
ones as one row, and the values at the ranks are read off. So what is shuffled follows the cells and the values in the last cells. The
samples are looked up in the wanted cells by a semi join: Spark broadcasts these while they are small, else each sample moves once,
and a hot group can be split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.paths import kept

#: Cells of the first round for each doubling of a value's size, how many of the next round are in one, and the most rounds.
STEPS, FINER, ROUNDS = 32, 128, 4


def cell(value: Column, level: int) -> Column:
    """The number of the cell of a value: never less for a larger value; cells of a level are parts of those of the level before."""
    v = value.cast("double")
    size = F.least(F.log2(F.abs(v)) + 1100, F.lit(2500.0))
    place = F.when(F.isnan(v), F.lit(3000.0)).when(v == 0, F.lit(0.0)).when(v > 0, size).otherwise(-size)
    return F.floor(place * (STEPS * FINER**level))


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]], slot: str | None = None, places: Column | None = None) -> DataFrame:
    """keys (and slot), n, and the values at ranks (from 1) given as functions of n, the number of values.

    slot, places: a further key, and the slots in which a row of a slot counts; being counted in must be mutual. Null values
    don't count; NaN is the largest; null keys are a group; an empty table gives no rows. A rank below 1 or above n gives null.
    """
    # A struct is one key, equal to itself where fields are null, so that joins and windows share an exchange.
    one = F.struct(F.lit(0).alias("__0"), *(F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys))).alias("__key")
    group = ["__key", slot] if slot else ["__key"]
    samples = df.where(F.col(f"`{value}`").isNotNull()).select(one, *group[1:], F.col(f"`{value}`").alias("__v"))
    spread = (lambda d: d.withColumn(slot, F.explode(places))) if slot else (lambda d: d)

    def inside(wanted: DataFrame | None, level: int) -> DataFrame:
        """The samples in wanted cells of the level before, with these as __parent."""
        if wanted is None:
            return samples.withColumn("__parent", F.lit(0).cast("long"))
        own = spread(wanted.select(*group, "__parent")).distinct()
        return samples.withColumn("__parent", cell(F.col("__v"), level - 1)).join(own, [*group, "__parent"], "left_semi")

    def summed(found: DataFrame, by: str, wanted: DataFrame | None) -> DataFrame:
        """Counts by group and `by`, with the ranks (__low, __high] that they take in the group, and its __n."""
        counts = found.groupBy(*group, "__parent", by).agg(F.count("*").alias("__c"))
        w = Window.partitionBy(*group, "__parent")
        if slot:
            # The copies of a cell come from other groups, so no partial sums are lost by moving them to their group first.
            counts = spread(counts).repartition(*group, "__parent").groupBy(*group, "__parent", by).agg(F.sum("__c").alias("__c"))
        if wanted is None:
            counts = counts.withColumns({"__n": F.sum("__c").over(w), "__before": F.lit(0).cast("long")})
        else:
            counts = counts.join(wanted.drop("__held"), [*group, "__parent"])
        high = F.col("__before") + F.sum("__c").over(w.orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
        return counts.withColumn("__high", high).withColumn("__low", F.col("__high") - F.col("__c"))

    def hit(rank: Column) -> Column:
        return (rank > F.col("__low")) & (rank <= F.col("__high"))

    wanted, level, crowded = None, 0, True
    while crowded and level < ROUNDS:
        held = summed(inside(wanted, level).withColumn("__cell", cell(F.col("__v"), level)), "__cell", wanted)
        any_rank = F.exists(F.array(*(rank(F.col("__n")).cast("long") for rank in ranks.values())), hit)
        # Groups without any rank inside keep their first cell, so that their number is known.
        chosen = held.where(any_rank | (F.col("__low") == 0))
        wanted = kept(chosen.select(*group, F.col("__cell").alias("__parent"), F.col("__low").alias("__before"), "__n", F.col("__c").alias("__held")), "ranks")
        crowded = (wanted.agg(F.avg("__held")).first()[0] or 0) > FINER
        level += 1
    last = summed(inside(wanted, level), "__v", wanted)
    found = last.groupBy(*group).agg(F.max("__n").alias("n"), *(F.max(F.when(hit(rank(F.col("__n"))), F.col("__v"))).alias(name) for name, rank in ranks.items()))
    return found.select(*(F.col("__key").getField(f"__k{i}").alias(k) for i, k in enumerate(keys)), *group[1:], "n", *ranks)
