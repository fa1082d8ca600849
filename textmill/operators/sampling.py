"""Rows of all sources in turns, spread over each source, until a budget of words is used up.

A source's rows are visited in an order whose every beginning is spread over the source: both ends, then the middle, then the
middles of the halves, and so on. In a turn each source gives its next row that still fits; what doesn't is never tried again.

So rows are admitted in rounds. In the order of (turn, source), sums of words tell how far everything fits, up to a first row that doesn't. From there on
no row that is larger than what is left can ever fit: all of them drop out, the others move up, and the next round goes on from that place. A round ends
with less room than a row that was there, so sizes over it are gone; rounds end when nothing is left that fits.

Every row that counts has a word or more. So of a source and a size only as many rows as fit together can matter, of a turn only as many sources as words
are left, and only as many turns: a round looks at no more than that in one task, whatever the number of sources and rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import positions, written


def spread_order(at: Column, n: Column) -> Column:
    """When row `at` (from 0) of n is visited: a number that sorts like it. The ends are -2 and -1; then the middles, numbered as in a
    tree: 1 is the whole, 2x its left half, 2x + 1 its right half."""
    first = F.struct(F.lit(0).cast("long").alias("low"), (n - 1).cast("long").alias("high"), F.lit(1).cast("long").alias("node"), F.lit(None).cast("long").alias("found"))

    def halve(s, _):
        middle = F.floor((s["low"] + s["high"]) / 2)
        left = at < middle
        return F.struct(
            F.when(left, s["low"]).otherwise(middle).alias("low"),
            F.when(left, middle).otherwise(s["high"]).alias("high"),
            F.when(s["found"].isNotNull() | (at == middle), s["node"]).otherwise(s["node"] * 2 + F.when(left, 0).otherwise(1)).alias("node"),
            F.coalesce(s["found"], F.when(at == middle, s["node"])).alias("found"),
        )

    # as many halvings as it takes until a span has no inside
    levels = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(n)).cast("int") + 1))
    return F.when(at == 0, F.lit(-2)).when(at == n - 1, F.lit(-1)).otherwise(F.aggregate(levels, first, halve, lambda s: s["found"])).cast("long")


def visits(rows: DataFrame, source: str, order: str) -> DataFrame:
    """rows with visit: a number that sorts as each source's rows are visited."""
    placed = positions(rows, [source], order)
    return placed.withColumn("visit", spread_order(F.col("place") - 1, F.col("count"))).drop("place", "count")


def turns(rows: DataFrame, source: str, order: str) -> DataFrame:
    """rows with turn: from 1, the place of each in its source's spread order."""
    return positions(visits(rows, source, order), [source], "visit").withColumnRenamed("place", "turn").drop("count", "visit")


def sampled(rows: DataFrame, source: str, order: str, words: str, budget: int) -> DataFrame:
    """The rows that are taken: source, order and words. Rows of more words than the budget, or none, never are; of equal (source, order) there may be one only."""
    w = F.col(words)
    visit = Window.partitionBy(source).orderBy("visit")
    left, taken = budget, []
    # turn and source from which the next round goes on: sources before it have had this turn
    turn, since = 0, None
    rest = written(visits(rows.select(source, order, words), source, order).where((w > 0) & (w <= budget)), "visits")
    while left > 0:
        waits = F.lit(0) if since is None else F.when(F.col(source) < F.lit(since), 1).otherwise(0)
        # of rows of one size a source's first ones that fit together are all that can come in
        row = rest.where(w <= left).withColumn("__n", F.row_number().over(Window.partitionBy(source, words).orderBy("visit"))).where((F.col("__n") <= left) & (F.col("__n") * w <= left))
        rest = written(row.select(source, order, words, "visit", (F.row_number().over(visit) - 1 + waits + turn).cast("long").alias("turn")), "visits")
        totals = rest.where(F.col("turn") <= turn + left + 1).groupBy("turn").agg(F.sum(words).alias("total"))
        upto = totals.withColumn("upto", F.sum("total").over(Window.orderBy("turn")))  # as many turns as words are left, at most
        whole, used, last = upto.agg(F.max(F.when(F.col("upto") <= left, F.col("turn"))), F.max(F.when(F.col("upto") <= left, F.col("upto"))), F.max("turn")).first()
        if last is None:
            break
        if whole is not None:
            taken.append(rest.where(F.col("turn") <= whole).select(source, order, words))
            left -= used
        if whole == last:
            break
        turn = rest.where(F.col("turn") > (turn - 1 if whole is None else whole)).agg(F.min("turn")).first()[0]
        # of the turn that doesn't fit as a whole: its first sources, one row each
        some = rest.where(F.col("turn") == turn).orderBy(source).limit(left + 1).withColumn("upto", F.sum(words).over(Window.orderBy(source)))
        fits, used, since = some.agg(F.max(F.when(F.col("upto") <= left, F.col(source))), F.max(F.when(F.col("upto") <= left, F.col("upto"))), F.min(F.when(F.col("upto") > left, F.col(source)))).first()
        gone = F.col("turn") < turn
        if fits is not None:
            taken.append(rest.where((F.col("turn") == turn) & (F.col(source) <= F.lit(fits))).select(source, order, words))
            left -= used
            gone = gone | ((F.col("turn") == turn) & (F.col(source) <= F.lit(fits)))
        rest = rest.where(~gone).drop("turn")
    if not taken:
        return rows.select(source, order, words).limit(0)
    out = taken[0]
    for part in taken[1:]:
        out = out.unionByName(part)
    return out
