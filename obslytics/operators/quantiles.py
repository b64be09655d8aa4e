"""Exact quantiles at any size, by radix selection on the order-preserving bits of a double.

A double's IEEE bits, negated for negative numbers, sort as the numbers do.  Each pass counts the rows of a group by a
prefix of these bits, among the rows that share the prefix found so far for some wanted rank, and lengthens the prefix;
after the last pass it is the number itself.  Only counts are shuffled (summed map-side first) and ordered, and the
counts of a group that meet in one task are at most ``2 ** width`` for each wanted rank, whatever the group's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: bits that each pass adds to the prefix; 64 in all
WIDTHS = (22, 21, 21)
#: grouping keys whose domain is fixed and small: a table with one row for each is safe to broadcast
BOUNDED = {"_all", "day_of_week", "behavioral_category", "hour", "time_period", "is_weekend"}


def with_order_bits(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds a long that sorts as the double ``value`` does and differs for different doubles; NaN is the largest, both
    zeros are equal.  Each step refers to the one before, so that no expression is written out twice."""
    infinite = "double('Infinity')"
    steps = df.selectExpr(
        *df.columns,
        f"if(isnan({value}) or abs({value}) = {infinite} or {value} = 0, 1d, abs({value})) as _size",
        "floor(log2(_size)) as _guess",
        "pow(2d, _guess) as _power",  # exact for whole exponents
        # the logarithm may be off by one next to a power of two
        "case when _size < _power then _guess - 1 when _size / 2 >= _power then _guess + 1 else _guess end as _exponent",
        "greatest(_exponent, -1022l) as _least",
        "floor(_least / 2) as _half",
        # below 1 for numbers beneath the normal range, else from 1 to 2
        "_size * pow(2d, -_half) * pow(2d, _half - _least) as _mantissa",
        f"""case when isnan({value}) then {(2047 << 52) + 1}l when abs({value}) = {infinite} then {2047 << 52}l when {value} = 0 then 0l
            else cast(_mantissa * {2.0**52} as long) + (_least + 1022) * {1 << 52}l end as _unsigned""",
        f"if({value} < 0, -_unsigned, _unsigned) as {out}")
    return steps.select(*df.columns, out)


def _keep_small(df: DataFrame, by: str) -> DataFrame:
    """Broadcast hint only for tables keyed by a bounded domain; otherwise AQE decides from the measured size."""
    return F.broadcast(df) if by in BOUNDED else df


def exact_quantiles(df: DataFrame, by: str, value: str, probabilities: list[float]) -> DataFrame:
    """Rows (by, n, q): linearly interpolated quantiles of ``value`` per ``by``; null values are left out, a null ``by`` is a group."""
    rows = df.select(F.col(by).alias("_by"), F.col(value).cast("double").alias("_v")).where("_v is not null")
    rows = with_order_bits(rows, "_v", "_bits")
    at = [f"((_n - 1) * {float(p)!r}d)" for p in probabilities]
    ranks = [f"cast({f}{x} as long)" for x in at for f in ("floor", "ceil")]
    some = range(len(ranks))
    # per group: the rows, for each rank the prefix that holds it and its place among the rows of all such prefixes
    kept = ["_n", *(f"_r{i}" for i in some)]
    found = [f"_p{i}" for i in some]
    ahead = "coalesce(sum(m) over (partition by _by order by _prefix rows between unbounded preceding and 1 preceding), 0l)"
    holds = [f"_r{i} >= _ahead and _r{i} < _ahead + m" for i in some]
    state, left = None, 64
    for width in WIDTHS:
        parent, left = f"shiftright(_bits, {left})", left - width
        if state is None:
            cells = rows.groupBy("_by", F.expr(f"shiftright(_bits, {left}) as _prefix")).agg(F.expr("count(1) as m"), F.expr("min(_v) as v"))
            cells = cells.selectExpr("*", "sum(m) over (partition by _by) as _n").selectExpr("*", *(f"{r} as _r{i}" for i, r in enumerate(ranks)), f"{ahead} as _ahead")
        else:
            near = rows.join(_keep_small(state, by), F.expr(f"_by <=> _group and {parent} in ({', '.join(found)})"))
            cells = near.groupBy("_by", F.expr(f"shiftright(_bits, {left}) as _prefix")).agg(
                F.expr("count(1) as m"), F.expr("min(_v) as v"), *(F.expr(f"max({c}) as {c}") for c in kept)).selectExpr("*", f"{ahead} as _ahead")
        cells = cells.where(" or ".join(f"({h})" for h in holds)).selectExpr("*", f"{ahead} as _chosen")
        done = cells.groupBy(F.col("_by").alias("_group")).agg(
            F.expr("max(_n) as _n"), *(F.expr(f"max(if({h}, {c}, null)) as {name}{i}") for i, h in enumerate(holds)
                                       for name, c in (("_p", "_prefix"), ("_r", f"_r{i} - _ahead + _chosen"), ("_v", "v"))))
        state = done.select("_group", *kept, *found)
    values = [f"if(floor{x} = ceil{x}, _v{2 * i}, (ceil{x} - {x}) * _v{2 * i} + ({x} - floor{x}) * _v{2 * i + 1})" for i, x in enumerate(at)]
    return done.select(F.col("_group").alias(by), F.col("_n").alias("n"), F.expr(f"array({', '.join(values)})").alias("q"))
