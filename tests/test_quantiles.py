import math
import re
import struct

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from obslytics.operators import charts as C
from obslytics.operators import quantiles as Q


def bits_of(x):
    if math.isnan(x):
        return (2047 << 52) + 1
    raw = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -raw if x < 0 else raw


def test_bits_are_those_of_the_double(spark):
    rng = np.random.default_rng(1)
    values = np.frombuffer(rng.bytes(8 * 20000), "<f8")
    edges = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 2.0**-1023, math.nextafter(2.0**-1022, 0), 1.7976931348623157e308, math.inf, -math.inf, math.nan, 1 / 3, 8.0]
    edges += [f(2.0**e) for e in range(-1074, 1024, 3) for f in (float, lambda x: math.nextafter(x, 0), lambda x: math.nextafter(x, math.inf))]
    values = [float(x) for x in values] + edges
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r["i"]: r["bits"] for r in Q.with_order_bits(df, "v", "bits").collect()}
    for i, v in enumerate(values):
        assert got[i] == bits_of(v), v


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.none() | st.floats(allow_nan=False, allow_infinity=False, width=32)), min_size=1, max_size=60))
def test_quantiles_against_numpy(spark, rows):
    df = spark.createDataFrame(rows, "g string, v double")
    at = [0.0, 0.1, 0.5, 1.0]
    got = {r["g"]: (r["n"], list(r["q"])) for r in Q.exact_quantiles(df, "g", "v", at).collect()}
    want = {g: [v for h, v in rows if h == g and v is not None] for g in ("a", "b", None)}
    assert set(got) == {g for g, v in want.items() if v}
    for g, (n, q) in got.items():
        assert n == len(want[g]) and np.allclose(q, np.quantile(want[g], at), rtol=1e-12, atol=1e-300)


def test_values_that_agree_in_all_but_the_last_bits(spark):
    values = [1.0]
    for _ in range(400):
        values.append(math.nextafter(values[-1], 2))
    df = spark.createDataFrame([(0, v) for v in values], "g int, v double")
    row = Q.exact_quantiles(df, "g", "v", [0.25, 0.5]).first()
    assert list(row["q"]) == [values[100], values[200]]


def test_only_counts_are_shuffled(spark):
    df = spark.range(20000).select((F.col("id") % 7).cast("string").alias("day_of_week"), F.rand(3).alias("confidence"))
    plan = C.exact_quantiles(df, "day_of_week", "confidence", [0.5])._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
    executed = C.exact_quantiles(df, "day_of_week", "confidence", [0.5])._jdf.queryExecution().executedPlan().toString()
    lines = executed.split("\n")
    for i, line in enumerate(lines):  # below every shuffle of rows stands a partial aggregate, or what such a shuffle gave
        if re.search(r"Exchange hashpartitioning\(_by#\d+, _prefix", line):
            assert "partial_count(1)" in lines[i + 1]
