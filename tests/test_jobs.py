"""Sources, sinks and operational jobs: file round trips."""

import base64
import datetime as dt
import os

from pyspark.sql import functions as F

from obslytics import schemas as S
from obslytics.functions import features as X
from obslytics.operators import jobs as J
from obslytics.operators import patterns as P
from obslytics.plans import catalog
from obslytics.sources import adapter as A
from obslytics.sources import readers as R
from conftest import SF_SMALL


def test_append_and_read_partitioned(spark, tmp_dir):
    a = A.load_activities(spark, SF_SMALL)
    R.append_activities(a, f"{tmp_dir}/acts")
    back = R.read_activities(spark, f"{tmp_dir}/acts", A.AS_OF, 7)
    want = R.read_activities(spark, a, A.AS_OF, 7)
    assert back.count() == want.count()
    p = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in p


def test_append_labels(spark, tmp_dir):
    R.append_labels(A.load_labeling(spark, SF_SMALL), f"{tmp_dir}/labels")
    assert spark.read.parquet(f"{tmp_dir}/labels").count() == A.table(spark, SF_SMALL, "labels").count()


def test_backup_manifest_counts(spark, tmp_dir):
    tables = {"activities": A.load_activities(spark, SF_SMALL), "labeling_data": A.load_labeling(spark, SF_SMALL)}
    m = {r["table"]: r["rows"] for r in J.backup(tables, tmp_dir, A.AS_OF).collect()}
    assert m["activities"] == tables["activities"].count()
    snap = R.read_snapshot(spark, f"{tmp_dir}/backup_20240131_000000", "labeling_data")
    assert snap.count() == m["labeling_data"]


def test_retention_keeps_complement(spark, tmp_dir):
    a = A.load_activities(spark, SF_SMALL)
    kept = J.apply_retention(a, f"{tmp_dir}/kept", A.AS_OF, 14)
    stats = J.retention_stats({"activities": a}, A.AS_OF, 14).first()
    assert kept.count() + stats["activities_deleted"] == a.count()


def test_report_written_as_json(spark, tmp_dir):
    rep = P.analysis_report(catalog.enriched(spark, SF_SMALL))
    J.write_report(rep, f"{tmp_dir}/report")
    d = J.report_to_dict(rep)
    assert d["data_summary"]["total_activities"] == catalog.enriched(spark, SF_SMALL).count()
    assert len(d["activity_patterns"]["activity_patterns"]) == 15
    assert any(f.endswith(".json") for f in os.listdir(f"{tmp_dir}/report"))


def test_split_valid(spark):
    raw = spark.createDataFrame([("1", "2024-01-01 00:00:00", "sitting", "0.5", "d", "live", "s"),
                                 ("2", "nope", "sitting", "0.5", "d", "live", "s"),
                                 ("3", "2024-01-01 00:00:00", None, "0.5", "d", "live", "s"),
                                 ("4", "2024-01-01 00:00:00", "sitting", "1.5", "d", "live", "s")],
                                "id string, timestamp string, activity_type string, confidence string, "
                                "description string, video_source string, session_id string")
    valid, rejected = R.split_valid(raw, S.ACTIVITIES, ranges={"confidence": (0.0, 1.0)})
    assert [r["id"] for r in valid.collect()] == ["1"]
    reasons = {r["id"]: r["reasons"] for r in rejected.collect()}
    assert reasons["2"] == ["type:timestamp"] and reasons["3"] == ["null:activity_type"]
    assert reasons["4"] == ["range:confidence"]


def test_decode_payload_and_videos(spark, tmp_dir):
    blob = b"\xff\xd8fake-jpeg"
    s = base64.b64encode(blob).decode()
    df = spark.createDataFrame([(s,), ("data:image/jpeg;base64," + s,)], "video_frame string")
    assert [r[0] for r in df.select(X.decode_payload()).collect()] == [blob, blob]
    os.makedirs(f"{tmp_dir}/up")
    for name in ["a.mp4", "b.txt", "c.MOV"]:
        with open(f"{tmp_dir}/up/{name}", "wb") as fh:
            fh.write(b"fake video content for testing")
    got = sorted(os.path.basename(r["path"]) for r in R.read_videos(spark, f"{tmp_dir}/up").collect())
    assert got == ["a.mp4", "c.MOV"]


def test_ingest_detections_one_session_per_upload(spark):
    from obslytics.operators import sequences as SQ
    d = SQ.ingest_detections(A.load_frames(spark, SF_SMALL), "uploaded")
    per = d.groupBy("upload_id").agg(F.count_distinct("session_id").alias("s")).agg(F.max("s")).first()[0]
    assert per == 1


def test_reading_stored_table_leaves_schema_alone(spark, tmp_dir):
    before = list(S.ACTIVITIES.fieldNames())
    R.append_activities(A.load_activities(spark, SF_SMALL), f"{tmp_dir}/acts")
    R.read_activities(spark, f"{tmp_dir}/acts", A.AS_OF, 30).count()
    R.read_activities(spark, f"{tmp_dir}/acts", A.AS_OF, 30).count()
    assert list(S.ACTIVITIES.fieldNames()) == before


def test_chart_report_writes_all_panels(spark, tmp_dir):
    from obslytics.plans import reports
    df = catalog.enriched(spark, SF_SMALL)
    s = reports.chart_report(df, f"{tmp_dir}/charts").first()
    assert s["visualizations_generated"] == 5 and s["total_activities"] == df.count()
    for name in reports.chart_panels(df):
        assert spark.read.parquet(f"{tmp_dir}/charts/{name}").count() > 0


def test_checkpoint_dir_uses_configured_folder(spark):
    from obslytics.session import checkpoint_dir
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert configured and checkpoint_dir(spark) == configured
    assert spark.sparkContext.getCheckpointDir().endswith(configured.split("/")[-1]) or \
        configured in spark.sparkContext.getCheckpointDir()


def test_configure_for_scale(spark):
    from obslytics.session import configure_for_scale
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes")}
    try:
        conf = configure_for_scale(spark, 100 * 10 ** 12)
        assert int(conf["spark.sql.shuffle.partitions"]) == -(-100 * 10 ** 12 // (128 << 20))
        assert configure_for_scale(spark, 10 ** 9)["spark.sql.shuffle.partitions"] == "8"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
