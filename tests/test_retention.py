import datetime as dt

import pytest
from pyspark.sql import functions as F

from obslytics.operators import jobs as J
from obslytics.operators import retention as RT

AS_OF = dt.datetime(2024, 1, 31, 12, 0)


def rows(spark, days=20, per=5):
    at = [(f"{d}-{i}", dt.datetime(2024, 1, 5) + dt.timedelta(days=d, hours=5 * i)) for d in range(days) for i in range(per)]
    return spark.createDataFrame([*at, ("none", None)], "id string, timestamp timestamp")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def files(spark, root, table):
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{root}/{table}")
    return {r["path"].split(f"/{table}/")[1]: r["modificationTime"] for r in found.select("path", "modificationTime").collect()}


def test_only_the_day_of_the_cutoff_is_rewritten(spark, tmp_dir):
    a, b = rows(spark), rows(spark, 3)
    RT.store_tables({"a": a, "b": b}, tmp_dir)
    old = files(spark, tmp_dir, "a")
    got = {r["table"]: r.asDict() for r in RT.retain(spark, tmp_dir, AS_OF, 20).collect()}  # cutoff 11 January, noon
    want = ids(a.where("timestamp >= '2024-01-11 12:00:00' or timestamp is null"))
    assert ids(RT.read_stored(spark, tmp_dir, "a")) == want
    assert got["a"] == {"table": "a", "rows_read": 5, "rows_deleted": 101 - len(want), "rows_kept": len(want), "days_dropped": 6, "cutoff": "2024-01-11T12:00:00"}
    assert ids(RT.read_stored(spark, tmp_dir, "b")) == ["none"] and got["b"]["rows_read"] == 0
    new = files(spark, tmp_dir, "a")
    assert all(new[f] == t for f, t in old.items()) and all(f.startswith("generation=1/date=2024-01-11/") for f in set(new) - set(old))
    # once more: a cutoff at midnight reads nothing; later ones may leave nothing but rows without a time
    again = {r["table"]: r["rows_read"] for r in RT.retain(spark, tmp_dir, dt.datetime(2024, 1, 31), 19).collect()}
    assert again == {"a": 0, "b": 0}
    RT.retain(spark, tmp_dir, dt.datetime(2025, 1, 31), 19)
    assert ids(RT.read_stored(spark, tmp_dir, "a")) == ["none"]


def test_a_run_that_breaks_off_before_the_switch(spark, tmp_dir, monkeypatch):
    a = rows(spark)
    RT.store_tables({"a": a}, tmp_dir)

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(RT, "publish", lost)
        with pytest.raises(RuntimeError):
            RT.retain(spark, tmp_dir, AS_OF, 20)
    assert ids(RT.read_stored(spark, tmp_dir, "a")) == ids(a)
    assert RT.unnamed_folders(spark, tmp_dir, "a") == ["generation=1/date=2024-01-11"]
    RT.retain(spark, tmp_dir, AS_OF, 20)  # run again, it replaces what the lost run wrote
    assert ids(RT.read_stored(spark, tmp_dir, "a")) == ids(a.where("timestamp >= '2024-01-11 12:00:00' or timestamp is null"))
    assert RT.unnamed_folders(spark, tmp_dir, "a") == []


def test_empty_tables(spark, tmp_dir):
    empty = rows(spark).limit(0)
    RT.store_tables({"a": empty, "b": rows(spark, 2)}, f"{tmp_dir}/s")
    got = {r["table"]: r["rows_kept"] for r in RT.retain(spark, f"{tmp_dir}/s", dt.datetime(2026, 1, 1), 1).collect()}
    assert got == {"a": 0, "b": 1}
    assert RT.read_stored(spark, f"{tmp_dir}/s", "a").schema == empty.schema
    assert RT.read_stored(spark, f"{tmp_dir}/s", "a").count() == 0
    with pytest.raises(FileNotFoundError):
        RT.read_stored(spark, f"{tmp_dir}/nothing", "a")
    kept = J.apply_retention(empty.withColumn("date", F.to_date("timestamp")), f"{tmp_dir}/kept", AS_OF, 3)
    assert kept.count() == 0 and "date" in kept.columns
