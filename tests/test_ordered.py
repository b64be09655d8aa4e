"""The skew-safe ordered index equals a plain window, also with one key
holding most of the rows."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from obslytics.operators.ordered import ordered_index


def test_hot_key_matches_window(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [("hot" if i % 4 else f"k{i % 7}", base + dt.timedelta(seconds=(i * 7919) % 5000), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, tie long")
    got = ordered_index(df, ["key"], "ts", "tie")
    w = Window.partitionBy("key").orderBy("ts", "tie")
    want = df.withColumn("rn", F.row_number().over(w)).withColumn("prev", F.lag("ts").over(w))
    a = sorted(got.select("key", "tie", "rn", "prev").collect())
    b = sorted(want.select("key", "tie", "rn", "prev").collect())
    assert a == b


def test_rows_without_a_time_are_spread(spark):
    """Half of a key's rows have no time: they come first, each at its own place, dealt to many buckets."""
    base = dt.datetime(2024, 1, 1)
    rows = [("hot" if i % 3 else "k", None if i % 2 else base + dt.timedelta(seconds=i), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, tie long")
    got = ordered_index(df, ["key"], "ts", "tie", size_col="size").collect()
    for key in ("hot", "k"):
        own = sorted((r["rn"], r["ts"], r["prev"], r["size"]) for r in got if r["key"] == key)
        want = sorted((r[1] for r in rows if r[0] == key), key=lambda t: (t is not None, t))
        assert [r[0] for r in own] == list(range(1, len(want) + 1)) and [r[1] for r in own] == want
        assert [r[2] for r in own] == [None, *want[:-1]] and all(r[3] == len(want) for r in own)
    # the same places whenever the rows are read again
    again = {r["tie"]: r["rn"] for r in ordered_index(df.repartition(7), ["key"], "ts", "tie").collect()}
    assert again == {r["tie"]: r["rn"] for r in got}


def test_global_order(spark):
    df = spark.range(2000).select(((F.col("id") * 37) % 2000).alias("ts"), F.col("id").alias("tie"))
    got = ordered_index(df, [], "ts", "tie", bucket=lambda c: F.floor(F.col(c) / 100))
    rows = got.select("ts", "rn", "prev").collect()
    assert all(r["rn"] == r["ts"] + 1 for r in rows)
    assert all((r["prev"] is None) == (r["ts"] == 0) for r in rows)
    assert all(r["prev"] is None or r["prev"] == r["ts"] - 1 for r in rows)


def test_rows_are_shuffled_once_by_bucket(spark):
    """A key holding 3/4 of the rows is dealt by minute: one exchange of rows, no checkpoint, no sort of a whole key."""
    base = dt.datetime(2024, 1, 1)
    rows = [("hot" if i % 4 else f"k{i % 50}", base + dt.timedelta(seconds=i), i) for i in range(40000)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, tie long")
    out = ordered_index(df, ["key"], "ts", "tie")
    out.write.format("noop").mode("overwrite").save()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    # the rows once; the partial aggregate over the same buckets, and its running sums on their way back
    assert plan.count("Exchange hashpartitioning(_g#") == 3
    assert all("Aggregate(keys=[_g#" in part or "Window" in part for part in plan.split("Exchange hashpartitioning(_g#")[2:])
    assert "rangepartitioning" not in plan and "Scan ExistingRDD Checkpoint" not in plan
    assert out.groupBy("key", F.date_trunc("minute", "ts")).count().agg(F.max("count")).first()[0] <= 60


def test_ordered_index_property(spark):
    """Random keys (with a dominant one), repeated timestamps and bucket
    widths: the ordered index always equals a plain window."""
    from hypothesis import given, settings, strategies as st, HealthCheck

    row = st.tuples(st.sampled_from(["hot", "hot", "hot", "a", "b", None]), st.integers(0, 50))

    @settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
    @given(rows=st.lists(row, min_size=1, max_size=80), width=st.integers(1, 30))
    def check(rows, width):
        base = dt.datetime(2024, 1, 1)
        data = [(k, base + dt.timedelta(seconds=s), i) for i, (k, s) in enumerate(rows)]
        df = spark.createDataFrame(data, "key string, ts timestamp, tie long")
        got = ordered_index(df, ["key"], "ts", "tie", bucket=lambda c: F.floor(F.unix_seconds(F.col(c)) / width))
        w = Window.partitionBy("key").orderBy("ts", "tie")
        want = df.withColumn("rn", F.row_number().over(w)).withColumn("prev", F.lag("ts").over(w))
        cols = ["key", "tie", "rn", "prev"]
        norm = lambda rs: sorted(rs, key=lambda r: (r[0] is None, r[0] or "", r[1]))
        assert norm([tuple(r) for r in got.select(*cols).collect()]) == \
            norm([tuple(r) for r in want.select(*cols).collect()])

    check()
