"""Exact quantiles of many groups at once, whatever the size of a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    """Null-safe equality of the named columns, as a null key is a group too."""
    return reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[n]) for n in names])


def join_groups(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the other columns of ``table``, which has one row a group; a null key is a group too."""
    other = table.withColumnsRenamed({k: f"{k}__of" for k in keys})
    return rows.join(other, [rows[k].eqNullSafe(other[f"{k}__of"]) for k in keys], how).drop(*[f"{k}__of" for k in keys])


def group_quantiles(frame: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]], bins: int = 1024, few: int = 20_000) -> DataFrame:
    """A row a group with the exact quantiles ``wanted``: name to (value, q), interpolated between neighbours.

    Each wanted rank of a group has a bracket [low, high] of values.  A round counts the
    values of all brackets of more than ``few`` values by bins, which merge across tasks,
    and moves each rank into its bin, from the bin's smallest to its largest value.  What
    is left of a bracket is sorted in one task, at most ``few`` values.  So the number of
    jobs depends on how the values spread, not on the number of groups, and no task holds
    a large group.  Null and non-finite values are left out; a group without others has
    no row.
    """
    one = [] if keys else ["all__"]
    by = [*(keys or one), "m__"]
    pairs = [F.struct(F.lit(i).alias("m__"), value.cast("double").alias("r__")) for i, (value, _) in enumerate(wanted.values())]
    r = frame.select(*keys, *[F.lit(0).alias(c) for c in one], F.explode(F.array(*pairs)).alias("x__"))
    r = r.select(*by[:-1], "x__.*").filter(F.abs("r__") < float("inf"))
    sizes = materialize(r.groupBy(*by).agg(F.count("*").alias("n"), F.min("r__").alias("low"), F.max("r__").alias("high")), "quantile-sizes")
    at = F.array(*[F.lit(float(q)) for _, q in wanted.values()])[F.col("m__")] * (F.col("n") - 1)
    ranks = sizes.withColumn("at", at).withColumn("share", F.col("at") - F.floor("at"))
    second = F.least(F.floor("at") + 1, F.col("n") - 1)
    targets = ranks.withColumn("t", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor("at").alias("rank")), F.struct(F.lit(1).alias("side"), second.alias("rank")))))
    targets = targets.select(*by, "share", "t.*", "low", "high", "n")
    wide = (F.col("low") < F.col("high")) & (F.col("high") / 2 - F.col("low") / 2 > 0)
    open_ = wide & (F.col("n") > few)
    while not targets.filter(open_).isEmpty():
        brackets = targets.filter(open_).select(*by, "low", "high").distinct()
        inside = join_groups(r, brackets, by).filter(F.col("r__").between(F.col("low"), F.col("high")))
        width = F.col("high") / 2 - F.col("low") / 2
        spot = F.least(F.floor((F.col("r__") / 2 - F.col("low") / 2) / width * bins).cast("int"), F.lit(bins - 1))
        cells = inside.groupBy(*by, F.col("low").alias("of"), spot.alias("bin")).agg(F.count("*").alias("n"), F.min("r__").alias("low"), F.max("r__").alias("high"))
        run = Window.partitionBy(*by, "of").orderBy("bin")  # a row a bin
        cells = cells.withColumn("before", F.sum("n").over(run) - F.col("n")).select(*by, "of", "before", F.col("n").alias("cell_n"), F.col("low").alias("cell_low"), F.col("high").alias("cell_high"))
        met = targets.filter(open_).join(
            cells.withColumnsRenamed({k: f"{k}of" for k in by}),
            [F.col(k).eqNullSafe(F.col(f"{k}of")) for k in by] + [F.col("low") == F.col("of"), F.col("rank") >= F.col("before"), F.col("rank") < F.col("before") + F.col("cell_n")],
        )
        moved = met.select(*by, "share", "side", (F.col("rank") - F.col("before")).alias("rank"), F.col("cell_low").alias("low"), F.col("cell_high").alias("high"), F.col("cell_n").alias("n"))
        targets = materialize(moved.unionByName(targets.filter(~open_)), "quantile-targets")
    ends = targets.filter(wide).select(*by, F.col("low").alias("of"), "high").distinct()
    rest = join_groups(r, ends, by).filter(F.col("r__").between(F.col("of"), F.col("high")))
    rest = rest.groupBy(*by, "of").agg(F.sort_array(F.collect_list("r__")).alias("values")).withColumnsRenamed({k: f"{k}of" for k in by})
    found = targets.join(rest, [F.col(k).eqNullSafe(F.col(f"{k}of")) for k in by] + [F.col("low") == F.col("of")], "left")
    value = F.coalesce(F.col("values")[F.col("rank").cast("int")], F.col("low"))
    part = F.when(F.col("side") == 0, (1 - F.col("share")) * value).otherwise(F.col("share") * value)
    out = found.select(*by, part.alias("part"))
    names = [F.sum(F.when(F.col("m__") == i, F.col("part"))).alias(name) for i, name in enumerate(wanted)]
    return out.groupBy(*by[:-1]).agg(*names).drop(*one)


def _middle(values: Column) -> Column:
    """The median of a sorted array; null for none."""
    n = F.size(values)
    return F.when(n > 0, (values[F.floor((n - 1) / 2).cast("int")] + values[F.floor(n / 2).cast("int")]) / 2)


def group_mad(frame: DataFrame, keys: list[str], value: Column, name: str = "mad_sigma", most: int | None = None, few: int = 20_000, bins: int = 1024) -> DataFrame:
    """A row a group with 1.4826 times the exact median absolute deviation of ``value``.

    Where the caller knows that no group has more than ``most`` values, and these are no
    more than ``few``, a group is sorted in one task and nothing is asked beforehand.
    """
    r = frame.select(*keys, value.cast("double").alias("r"))
    if most is not None and most <= few:
        held = r.filter(F.abs("r") < float("inf")).groupBy(*keys).agg(F.sort_array(F.collect_list("r")).alias("values")).withColumn("med", _middle(F.col("values")))
        away = F.sort_array(F.transform("values", lambda x: F.abs(x - F.col("med"))))
        return held.withColumn("away", away).select(*keys, (_middle(F.col("away")) * 1.4826).alias(name))
    # A row a group, kept: each scan below joins it as a small table, and none computes it again.
    med = materialize(group_quantiles(r, keys, {"med__": (F.col("r"), 0.5)}, bins, few), "mad-medians")
    both = join_groups(r, med, keys) if keys else r.crossJoin(F.broadcast(med))  # one row if there are no keys
    return group_quantiles(both, keys, {name: (F.abs(F.col("r") - F.col("med__")) * 1.4826, 0.5)}, bins, few)
