"""Explicit schemas and the fixed values the analyses depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- fixed values (must stay as written: results depend on them) -----------

# Activity classes in their canonical order, with behavioural category,
# alertable flag and display colour.
TAXONOMY = [
    (0, "sitting", "Calm", False, "#90EE90"),
    (1, "standing", "Calm", False, "#87CEEB"),
    (2, "walking", "Active", False, "#DDA0DD"),
    (3, "running", "Active", False, "#F0E68C"),
    (4, "jumping", "Active", False, "#FFB6C1"),
    (5, "hand_flapping", "Stimming", False, "#87CEFA"),
    (6, "rocking", "Stimming", False, "#98FB98"),
    (7, "spinning", "Stimming", False, "#F5DEB3"),
    (8, "head_banging", "Concerning", False, "#FFB6C1"),
    (9, "wandering", "Concerning", True, "#CD853F"),
    (10, "aggressive_behavior", "Concerning", True, "#DC143C"),
    (11, "self_harm", "Concerning", True, "#8B0000"),
    (12, "focused_activity", "Therapeutic", False, "#9370DB"),
    (13, "social_interaction", "Therapeutic", False, "#20B2AA"),
    (14, "therapy_exercise", "Therapeutic", False, "#32CD32"),
]

CATEGORY_COLORS = [
    ("Calm", "#2E8B57"),
    ("Active", "#FF6B35"),
    ("Stimming", "#4169E1"),
    ("Concerning", "#DC143C"),
    ("Therapeutic", "#9370DB"),
]
DEFAULT_COLOR = "#808080"

ALERTABLE = ["aggressive_behavior", "self_harm", "wandering"]

DAY_ORDER = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
TIME_PERIODS = ["Night", "Morning", "Afternoon", "Evening"]
CONFIDENCE_BANDS = ["Low", "Medium", "High"]

RECOMMENDATIONS = [
    "Immediate intervention recommended for concerning behaviors",
    "Implement safety monitoring protocols",
    "Consider sensory regulation activities",
    "Monitor stimming patterns for triggers",
    "Continue current therapeutic activities - showing positive engagement",
    "Good balance of active and calm activities observed",
]

# Metric alert rules: type, severity, metric column, strict threshold, message.
METRIC_ALERT_RULES = [
    ("high_cpu", "warning", "cpu_percent", 80.0, "High CPU usage: %.1f%%"),
    ("high_memory", "warning", "memory_percent", 85.0, "High memory usage: %.1f%%"),
    ("high_disk", "critical", "disk_usage_percent", 90.0, "High disk usage: %.1f%%"),
]

DESCRIPTION_FORMAT = "Detected %s with %s confidence"
# Analysis text stored for alertable detections when no model answer exists.
AI_UNAVAILABLE = "AI analysis unavailable"
ANALYSIS_PROMPT_LINES = [
    "Analyze this activity detection:",
    "Activity: %s",
    "Confidence: %s",
    "Description: %s",
    "Timestamp: %s",
    "",
    "Provide behavioral insights and recommendations.",
]

# Driver-table adapter: position of events.event_type selects a block of
# three activity classes (FIXTURES.md section 4).
EVENT_TYPE_ORDER = ["view", "click", "signup", "error", "purchase"]

ACTIVITY_TYPES = [t[1] for t in TAXONOMY]
CATEGORY_OF = {t[1]: t[2] for t in TAXONOMY}

# --- schemas ----------------------------------------------------------------

BOX = T.MapType(T.StringType(), T.DoubleType())

ACTIVITIES = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("activity_type", T.StringType(), False),
    T.StructField("confidence", T.DoubleType(), False),
    T.StructField("bounding_box", BOX, True),
    T.StructField("description", T.StringType(), False),
    T.StructField("ai_analysis", T.StringType(), True),
    T.StructField("video_source", T.StringType(), False),
    T.StructField("session_id", T.StringType(), False),
])

LABEL_ITEM = T.StructType([
    T.StructField("activity", T.StringType(), True),
    T.StructField("confidence", T.DoubleType(), True),
])

LABELING_DATA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("video_frame", T.StringType(), True),
    T.StructField("labels", T.ArrayType(LABEL_ITEM), False),
    T.StructField("annotator_id", T.StringType(), False),
    T.StructField("session_id", T.StringType(), False),
])

SYSTEM_METRICS = T.StructType([
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("host", T.StringType(), False),
    T.StructField("cpu_percent", T.DoubleType(), False),
    T.StructField("memory_percent", T.DoubleType(), False),
    T.StructField("disk_usage_percent", T.DoubleType(), False),
    T.StructField("network_io", T.MapType(T.StringType(), T.LongType()), True),
    T.StructField("process_count", T.IntegerType(), False),
    T.StructField("load_average", T.ArrayType(T.DoubleType()), True),
])

FRAMES = T.StructType([
    T.StructField("upload_id", T.StringType(), False),
    T.StructField("frame_index", T.LongType(), False),
    T.StructField("payload", T.BinaryType(), True),
    T.StructField("detections", T.ArrayType(BOX), True),
])

TAXONOMY_SCHEMA = T.StructType([
    T.StructField("idx", T.IntegerType(), False),
    T.StructField("activity_type", T.StringType(), False),
    T.StructField("behavioral_category", T.StringType(), False),
    T.StructField("alertable", T.BooleanType(), False),
    T.StructField("activity_color", T.StringType(), False),
])


def taxonomy(spark: SparkSession) -> DataFrame:
    """The 15-row activity dimension; small by construction, safe to broadcast."""
    return spark.createDataFrame(TAXONOMY, TAXONOMY_SCHEMA)
