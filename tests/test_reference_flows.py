"""The reference's smoke flows, replayed through the Spark operators with its
own test inputs: store an activity, list it, summarise, timeline, store and
list a label record, alerts, frame payload, video upload filter, analysis."""

import base64
import datetime as dt
import os

import pytest

from obslytics import schemas as S
from obslytics.functions import features as X
from obslytics.operators import patterns as P
from obslytics.operators import summary as SM
from obslytics.sources import readers as R

NOW = dt.datetime(2024, 1, 31, 0, 0, 0)
BLUE_JPEG = base64.b64encode(b"\xff\xd8\xff\xe0fake-blue-640x480\xff\xd9").decode()


@pytest.fixture()
def store(spark, tmp_dir):
    """An activities table holding the reference's test activity."""
    row = spark.createDataFrame(
        [("sitting", 0.85, {"x": 100.0, "y": 100.0, "width": 200.0, "height": 300.0}, "Test activity detection",
          "test", "test_session", NOW - dt.timedelta(minutes=30))],
        "activity_type string, confidence double, bounding_box map<string,double>, description string, "
        "video_source string, session_id string, timestamp timestamp")
    R.append_activities(row, f"{tmp_dir}/activities")
    return f"{tmp_dir}/activities"


def test_create_and_list_activity(spark, store):
    df = spark.read.parquet(store)
    got = SM.recent(df, 100).collect()
    assert len(got) == 1
    r = got[0]
    assert r["activity_type"] == "sitting" and r["confidence"] == 0.85 and r["video_source"] == "test"
    assert r["bounding_box"]["width"] == 200.0 and len(r["id"]) == 36  # uuid filled in
    assert r["ai_analysis"] is None  # not alertable


def test_summary_and_timeline(spark, store):
    df = spark.read.parquet(store)
    s = SM.summary(df, NOW).first()
    assert s["total_activities"] == 1 and s["average_confidence"] == 0.85
    assert s["most_common_activity"] == "sitting" and s["hourly_distribution"][23] == 1
    t = SM.timeline(df, NOW).collect()
    assert [r["timestamp"] for r in t] == ["2024-01-30T23:30:00"]


def test_alerts_empty_for_calm_activity(spark, store):
    assert SM.alerts(spark.read.parquet(store), NOW).count() == 0


def test_labeling_roundtrip(spark, tmp_dir):
    item = [{"activity": "sitting", "confidence": 1.0}]
    rec = spark.createDataFrame([(BLUE_JPEG, item, "test_user", "test_session")],
                                "video_frame string, labels array<struct<activity:string,confidence:double>>, "
                                "annotator_id string, session_id string")
    R.append_labels(rec, f"{tmp_dir}/labels")
    got = R.read_labels(spark.read.parquet(f"{tmp_dir}/labels"), 50).collect()
    assert len(got) == 1 and got[0]["annotator_id"] == "test_user"
    assert got[0]["labels"][0]["activity"] == "sitting"


def test_frame_payload_and_upload_filter(spark, tmp_dir):
    df = spark.createDataFrame([(BLUE_JPEG,), ("data:image/jpeg;base64," + BLUE_JPEG,)], "frame string")
    raw = [r[0] for r in df.select(X.decode_payload("frame")).collect()]
    assert raw[0] == raw[1] and raw[0].startswith(b"\xff\xd8")
    os.makedirs(f"{tmp_dir}/up")
    with open(f"{tmp_dir}/up/test_video.mp4", "wb") as fh:
        fh.write(b"fake video content for testing")
    with open(f"{tmp_dir}/up/notes.txt", "wb") as fh:
        fh.write(b"not a video")
    vids = R.read_videos(spark, f"{tmp_dir}/up").collect()
    assert [os.path.basename(v["path"]) for v in vids] == ["test_video.mp4"]


def test_data_analysis_flow(spark, store):
    df = R.read_activities(spark, store, NOW, 7)
    p = P.patterns(df)
    ins = P.insights(p).collect()
    assert [(r["category"], r["total_occurrences"], r["risk_level"]) for r in ins] == [("Calm", 1, "Low")]
    top = P.top_patterns(p).collect()
    assert top[0]["activity"] == "sitting" and top[0]["confidence"] == 0.85 and top[0]["category"] == "Calm"
    assert set(S.ACTIVITIES.fieldNames()) <= set(spark.read.parquet(store).columns)
    assert p.first()["duration_minutes"] == 5.0  # a single event has the default duration


def test_alertable_activity_gets_analysis_text(spark, tmp_dir):
    row = spark.createDataFrame([("self_harm", 0.9, "test", "s", NOW - dt.timedelta(minutes=5))],
                                "activity_type string, confidence double, video_source string, session_id string, "
                                "timestamp timestamp")
    R.append_activities(row, f"{tmp_dir}/a")
    got = spark.read.parquet(f"{tmp_dir}/a").first()
    assert got["ai_analysis"] == S.AI_UNAVAILABLE
    assert got["description"] == "Detected self_harm with 0.90 confidence"
    assert SM.alerts(spark.read.parquet(f"{tmp_dir}/a"), NOW).count() == 1
