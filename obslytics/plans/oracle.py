"""DuckDB twins of the registered queries (the correctness oracle).

``BASE`` re-states the driver-table adapter of ``obslytics.sources.adapter``
in SQL; every oracle query starts from it.  Doubles are rounded to 6 places
and integers are BIGINT on both sides; dates and times are text.
"""

from __future__ import annotations

from obslytics import schemas as S

_TYPES = "[" + ", ".join(f"'{t}'" for t in S.ACTIVITY_TYPES) + "]"
_EVENTS = "[" + ", ".join(f"'{t}'" for t in S.EVENT_TYPE_ORDER) + "]"
_TAXO = ", ".join(f"({i}, '{a}', '{c}', {str(al).lower()}, '{col}')" for i, a, c, al, col in S.TAXONOMY)
_CAT_COLOR = " ".join(f"WHEN '{c}' THEN '{col}'" for c, col in S.CATEGORY_COLORS)
_ACT_COLOR = " ".join(f"WHEN '{a}' THEN '{col}'" for _, a, _, _, col in S.TAXONOMY)
_ALERTABLE = ", ".join(f"'{a}'" for a in S.ALERTABLE)

TS_TEXT = "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"
ISO_TEXT = ("CASE WHEN epoch_us({c}) % 1000000 = 0 THEN strftime({c}, '%Y-%m-%dT%H:%M:%S') "
            "ELSE strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') END")
PY_TEXT = ("CASE WHEN epoch_us({c}) % 1000000 = 0 THEN strftime({c}, '%Y-%m-%d %H:%M:%S') "
           "ELSE strftime({c}, '%Y-%m-%d %H:%M:%S.%f') END")


def fixed(c: str, places: int) -> str:
    return f"cast(round(cast({c} AS DECIMAL(24,10)), {places}) AS VARCHAR)"


BASE = f"""
WITH taxonomy(idx, activity_type, behavioral_category, alertable, activity_color) AS (VALUES {_TAXO}),
ev AS (
  SELECT event_id, ts, user_id, event_type, value,
         cast(json_extract(props, '$.k') AS INTEGER) AS k,
         list_position({_EVENTS}, event_type) - 1 AS e
  FROM events),
activities AS (
  SELECT cast(event_id AS VARCHAR) AS id,
         ts AS "timestamp",
         CASE WHEN e >= 0 THEN {_TYPES}[e * 3 + (k % 3) + 1] END AS activity_type,
         least(value, 100.0) / 100.0 AS confidence,
         'session_' || cast(user_id AS VARCHAR) AS session_id,
         CASE WHEN event_id % 2 = 0 THEN 'live' ELSE 'uploaded' END AS video_source,
         event_id, user_id, k
  FROM ev),
described AS (
  SELECT *, 'Detected ' || activity_type || ' with ' || {fixed('confidence', 2)} || ' confidence' AS description
  FROM activities),
enriched AS (
  SELECT a.*,
         hour(a."timestamp") AS hour,
         dayname(a."timestamp") AS day_of_week,
         cast(a."timestamp" AS DATE) AS date,
         weekofyear(a."timestamp") AS week,
         month(a."timestamp") AS month,
         isodow(a."timestamp") >= 6 AS is_weekend,
         CASE WHEN hour(a."timestamp") > 0 AND hour(a."timestamp") <= 6 THEN 'Night'
              WHEN hour(a."timestamp") > 6 AND hour(a."timestamp") <= 12 THEN 'Morning'
              WHEN hour(a."timestamp") > 12 AND hour(a."timestamp") <= 18 THEN 'Afternoon'
              WHEN hour(a."timestamp") > 18 AND hour(a."timestamp") <= 24 THEN 'Evening' END AS time_period,
         CASE WHEN a.confidence > 0 AND a.confidence <= 0.7 THEN 'Low'
              WHEN a.confidence > 0.7 AND a.confidence <= 0.85 THEN 'Medium'
              WHEN a.confidence > 0.85 AND a.confidence <= 1.0 THEN 'High' END AS confidence_category,
         t.behavioral_category
  FROM described a LEFT JOIN taxonomy t USING (activity_type)
  WHERE a."timestamp" >= TIMESTAMP '2024-01-01 00:00:00'),
patterns AS (
  SELECT activity_type, count(*) AS frequency, avg(confidence) AS avg_confidence,
         CASE WHEN count(*) < 2 THEN 5.0
              ELSE (epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / (count(*) - 1) / 60000000.0::DOUBLE END
           AS duration_minutes,
         min(behavioral_category) AS behavioral_category
  FROM enriched GROUP BY activity_type),
pattern_hours AS (
  SELECT activity_type, first(hour ORDER BY c DESC, hour ASC) AS time_of_day
  FROM (SELECT activity_type, hour, count(*) AS c FROM enriched GROUP BY 1, 2) GROUP BY 1),
labeling AS (
  SELECT cast(doc_id AS VARCHAR) AS id,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS "timestamp",
         CASE WHEN quality = 1 AND toxic = 1 THEN ['quality', 'toxic'] WHEN quality = 1 THEN ['quality']
              WHEN toxic = 1 THEN ['toxic'] ELSE []::VARCHAR[] END AS labels,
         cast(doc_id % 3 AS VARCHAR) AS annotator_id
  FROM labels),
metrics AS (
  SELECT ts AS "timestamp", 'host_' || cast(user_id % 5 AS VARCHAR) AS host,
         least(value, 100.0) AS cpu_percent, cast(k AS DOUBLE) AS memory_percent,
         cast((k * 7) % 100 AS DOUBLE) AS disk_usage_percent, 100 + k AS process_count
  FROM ev),
frames AS (
  SELECT cast(user_id AS VARCHAR) AS upload_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index,
         cast(event_id % 640 AS DOUBLE) AS x, cast(event_id % 480 AS DOUBLE) AS y,
         cast(20 + event_id % 120 AS DOUBLE) AS width, cast(20 + event_id % 90 AS DOUBLE) AS height
  FROM events)
"""

CAT_COLOR = f"CASE behavioral_category {_CAT_COLOR} ELSE '{S.DEFAULT_COLOR}' END"
ACT_COLOR = f"CASE activity_type {_ACT_COLOR} ELSE '{S.DEFAULT_COLOR}' END"
ALERTABLE = _ALERTABLE


def q(body: str) -> str:
    return BASE + body
