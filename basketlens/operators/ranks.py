"""Exact ranks, quantile scores and medians without a global sort in one task.

``Window.orderBy(x)`` without a partition moves every row to one task, and the
exact ``percentile`` aggregate holds every distinct value of a group in one
buffer.  :func:`value_ranks` gives the same exact answer with bounded tasks:

1. ties are collapsed into a histogram ``(by..., value, n)``;
2. every value falls into a range by its power of two and ``RANGES_PER_OCTAVE`` even
   steps inside it: a rule on the value alone, in order of the values;
3. a window per (group, range) gives running counts inside a range, and a window over
   the (group, range) totals -- at most about half a million ranges, whatever the
   data -- gives each range's offset.

The output row for a value carries ``below`` (rows with a strictly smaller
value), ``n`` (rows equal to it) and ``total`` (rows in the group).

Cut points and medians need a few positions of the sorted values, not all ranks:
:func:`order_statistics` counts ranges, cuts only the ranges that hold a position into
finer ones, and looks at single values only there.  What it shuffles depends on the
number of groups and positions, not on how many distinct values there are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions import to_double

RANGES_PER_OCTAVE = 256
SMALLEST_OCTAVE = -1075           # below the exponent of any double


def value_range(value: Column) -> Column:
    """The number of a value's range; never falls as the value rises.

    The step inside an octave is not clipped, so a logarithm that is rounded across a
    power of two still gives neighbouring numbers.
    """
    x = to_double(value)
    octave = F.floor(F.log2(F.abs(x)))
    step = F.floor((F.abs(x) / F.pow(F.lit(2.0), octave) - 1) * RANGES_PER_OCTAVE)
    number = (octave - SMALLEST_OCTAVE) * RANGES_PER_OCTAVE + step
    return F.when(x > 0, number).when(x < 0, -number).otherwise(F.lit(0)).cast("bigint")


def value_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``by..., value, n, below, total`` for every distinct ``value`` (NULLs excluded).

    ``by`` is meant for a handful of groups (measures, seller types); NULL is a group
    of its own.  The plan is lazy and the same for every size of input.
    """
    by = list(by)
    hist = (df.where(F.col(value).isNotNull())
            .groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("_b", value_range(F.col(value))))
    totals = hist.groupBy(*by, "_b").agg(F.sum("n").alias("_bn"))
    totals = (totals.withColumn("_off", F.sum("_bn").over(Window.partitionBy(*by).orderBy("_b"))
                                - F.col("_bn"))
              .withColumn("total", F.sum("_bn").over(Window.partitionBy(*by)))
              .select(*[F.col(c).alias(f"_t_{c}") for c in [*by, "_b"]], "_off", "total"))
    running = hist.withColumn("_run", F.sum("n").over(Window.partitionBy(*by, "_b").orderBy(value)))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in [*by, "_b"]])
    return (running.join(totals, same)
            .select(*by, value, "n", (F.col("_off") + F.col("_run") - F.col("n")).alias("below"), "total"))


#: Parts that a range with a wanted position is cut into.
CELLS = 4096


def _same(by: Sequence[str], prefix: str) -> Column:
    """Null-safe equality of the groups on both sides of a join (a constant for no groups)."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in by])


def order_statistics(df: DataFrame, value: str, positions: dict[str, Callable[[Column], Column]],
                     by: Sequence[str]) -> DataFrame:
    """``by..., total`` and a DOUBLE column for each position: exact order statistics.

    ``positions`` maps a name to a function of ``total`` (the group's rows; it may read
    the columns of ``by``) that gives a 0-based place among the sorted values; a place
    outside gives NULL.  NULL values are left out; values are finite and compared as DOUBLE.

    Three passes over ``df``, each with partial aggregation: rows per range; rows per cell
    of the few ranges that hold a wanted place (their true bounds are known by then); single
    values of the few cells that hold one.  ``by`` is meant for a handful of groups: the
    wanted ranges, one row for each group and position, are broadcast.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull()).select(*by, to_double(value).alias("_x"))
    size = [F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high")]
    first = rows.groupBy(*by, value_range(F.col("_x")).alias("_key")).agg(*size)
    first = (first.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*by).orderBy("_key")))
             .withColumn("total", F.sum("_n").over(Window.partitionBy(*by))))
    asked = [F.struct(F.lit(name).alias("name"), place(F.col("total")).cast("bigint").alias("place"))
             for name, place in positions.items()]
    before = F.col("_upto") - F.col("_n")
    # one row for each range that holds a place: its bounds and the places asked of it
    places = F.filter(F.array(*asked), lambda p: (p["place"] >= before) & (p["place"] < F.col("_upto")))
    cells = (first.withColumn("_asks", F.transform(places, lambda p: F.struct(p["name"].alias("name"), (p["place"] - before).alias("rest"))))
             .where(F.size("_asks") > 0).select(*by, "total", "_low", "_high", "_asks"))
    inside = (F.col("_x") >= F.col("_t__low")) & (F.col("_x") <= F.col("_t__high"))
    finer = F.floor((F.col("_x") - F.col("_t__low")) / (F.col("_t__high") - F.col("_t__low")) * CELLS)
    cell = [f"_t_{c}" for c in [*by, "_low", "_high"]]
    for key in (F.when(F.col("_t__high") > F.col("_t__low"), finer).otherwise(F.lit(0)).cast("bigint"), F.col("_x")):
        wanted = cells.select(*[F.col(c).alias(f"_t_{c}") for c in cells.columns])
        parts = (rows.join(F.broadcast(wanted), _same(by, "_t_") & inside)
                 .groupBy(*cell, key.alias("_key"))
                 .agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"),
                      F.first("_t_total").alias("total"), F.first("_t__asks").alias("_asks"))
                 .withColumn("_upto", F.sum("_n").over(Window.partitionBy(*cell).orderBy("_key"))))
        held = F.filter("_asks", lambda p: (p["rest"] >= before) & (p["rest"] < F.col("_upto")))
        left = F.transform(held, lambda p: F.struct(p["name"].alias("name"), (p["rest"] - before).alias("rest")))
        cells = (parts.withColumn("_asks", left).where(F.size("_asks") > 0)
                 .select(*[F.col(f"_t_{c}").alias(c) for c in by], "total", "_low", "_high", "_asks"))
    found = cells.select(*by, "total", "_low", F.explode("_asks").alias("_ask"))
    return found.groupBy(*by, "total").agg(*[F.max(F.when(F.col("_ask.name") == n, F.col("_low"))).alias(n) for n in positions])


def medians(df: DataFrame, value: str, by: Sequence[str], name: str = "median") -> DataFrame:
    """Exact interpolated median per group (DOUBLE), by :func:`order_statistics`."""
    half = {"_below": lambda total: F.floor((total - 1) / 2), "_above": lambda total: F.ceil((total - 1) / 2)}
    return order_statistics(df, value, half, by).select(*by, ((F.col("_below") + F.col("_above")) / 2.0).alias(name))


def selected_edges(df: DataFrame, value: str, by: Sequence[str], k: int = 5, higher_is_better=True) -> DataFrame:
    """The edges of :func:`quantile_edges`, as DOUBLE, without ranking every value.

    ``edge_j`` is the first value with at least ``c = ceil(j * total / k)`` rows strictly worse
    than it: the next value past the ``c``-th worst row.  The ``c``-th worst rows are order
    statistics; one more aggregate finds what comes next.
    """
    hib = F.lit(higher_is_better) if isinstance(higher_is_better, bool) else higher_is_better

    def worst(j: int) -> Callable[[Column], Column]:
        def place(total: Column) -> Column:
            c = F.ceil(total * j / k)
            return F.when(hib, c - 1).otherwise(total - c)
        return place

    found = order_statistics(df, value, {f"_w{j}": worst(j) for j in range(1, k)}, by)
    known = found.select(*[F.col(c).alias(f"_e_{c}") for c in by], *[f"_w{j}" for j in range(1, k)])
    x = to_double(value)
    rows = df.where(F.col(value).isNotNull()).join(F.broadcast(known), _same(by, "_e_"))      # a row a group
    edges = []
    for j in range(1, k):
        up, down = F.min(F.when(hib & (x > F.col(f"_w{j}")), x)), F.max(F.when(~hib & (x < F.col(f"_w{j}")), x))
        edges.append(F.coalesce(up, down).alias(f"edge_{j}"))
    return rows.groupBy(*by).agg(*edges)


def _worse(higher_is_better):
    """Rows with a strictly worse value; ``higher_is_better`` is a bool or a boolean Column."""
    above = F.col("total") - F.col("below") - F.col("n")
    if isinstance(higher_is_better, bool):
        return F.col("below") if higher_is_better else above
    return F.when(higher_is_better, F.col("below")).otherwise(above)


def quantile_score(ranks: DataFrame, k: int = 5, higher_is_better=True) -> DataFrame:
    """Adds ``score`` in 1..k: ``1 + floor(k * worse / total)``; ties share a score.

    ``worse`` is the number of rows with a strictly worse value (smaller when
    higher is better, larger otherwise).
    """
    worse = _worse(higher_is_better)
    scaled = worse * k
    whole = (scaled - scaled % F.col("total")) / F.col("total")   # exact integer division
    return ranks.withColumn("score", (F.lit(1) + whole).cast("bigint"))


def quantile_edges(ranks: DataFrame, value: str, by: Sequence[str] = (), k: int = 5,
                   higher_is_better=True) -> DataFrame:
    """The values where :func:`quantile_score` steps up: ``by..., edge_1 .. edge_{k-1}``.

    ``edge_j`` is the first value, going from worst to best, whose score is above
    ``j``: the smallest value with ``k * worse >= j * total`` when higher is better,
    the largest one otherwise (NULL when no value gets there).  ``score(v)`` is
    then ``1 + #{j : v >= edge_j}`` (``<=`` when lower is better), so a table of
    one row per group scores any number of rows without joining them to the ranks.
    """
    worse = _worse(higher_is_better)
    hib = F.lit(higher_is_better) if isinstance(higher_is_better, bool) else higher_is_better
    edges = []
    for j in range(1, k):
        reach = worse * k >= F.col("total") * j
        lowest = F.min(F.when(reach & hib, F.col(value)))
        highest = F.max(F.when(reach & ~hib, F.col(value)))
        edges.append(F.coalesce(lowest, highest).alias(f"edge_{j}"))
    return ranks.groupBy(*by).agg(*edges)


def score_by_edges(x, edges, k: int = 5, higher_is_better: bool = True):
    """``1 + #{j : x passes edges[j]}`` for an array column of ``k - 1`` edges
    (NULL edges are never passed)."""
    score = F.lit(1).cast("bigint")
    for j in range(k - 1):
        passes = (x >= edges[j]) if higher_is_better else (x <= edges[j])
        score = score + F.coalesce(passes, F.lit(False)).cast("bigint")
    return score


def ntile_of(position, total, k: int = 5):
    """SQL ``NTILE(k)`` bucket of a 1-based ``position`` among ``total`` rows."""
    q = F.floor(total / k)
    rem = total - q * k
    big = rem * (q + 1)
    first = F.ceil(position / (q + 1))
    rest = rem + F.ceil((position - big) / F.greatest(q, F.lit(1)))
    return F.when(position <= big, first).otherwise(rest).cast("bigint")


def tie_split(ranks: DataFrame, by: Sequence[str] = (), k: int = 5, higher_is_better=True) -> DataFrame:
    """How many tie groups a position-based ``NTILE(k)`` would cut into several tiles.

    ``(by..., distinct_values, split_values, rows_in_split_values)`` per group.
    """
    start = _worse(higher_is_better) + 1
    end = start + F.col("n") - 1
    split = ntile_of(start, F.col("total"), k) != ntile_of(end, F.col("total"), k)
    return ranks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("distinct_values"),
        F.count_if(split).alias("split_values"),
        F.coalesce(F.sum(F.when(split, F.col("n"))), F.lit(0)).cast("bigint").alias("rows_in_split_values"))


def median_from_ranks(ranks: DataFrame, value: str, by: Sequence[str] = (), name: str = "median") -> DataFrame:
    """Exact interpolated median per group (DOUBLE) from :func:`value_ranks` output.

    A plain grouped aggregate over the distinct values: no sort, no window.
    """
    lo = F.floor((F.col("total") - 1) / 2)
    hi = F.ceil((F.col("total") - 1) / 2)
    covers = lambda p: (F.col("below") <= p) & (p < F.col("below") + F.col("n"))
    return ranks.groupBy(*by).agg(
        ((to_double(F.min(F.when(covers(lo), F.col(value))))
          + to_double(F.min(F.when(covers(hi), F.col(value))))) / 2.0).alias(name))
