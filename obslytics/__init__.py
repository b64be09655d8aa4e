"""obslytics: Spark-native analytics over activity detections, labels and metrics.

Every public operator is a ``DataFrame -> DataFrame`` function built from
``pyspark.sql.functions`` expressions, MLlib estimators or Structured
Streaming queries.  Nothing here collects row data to the driver.
"""

from obslytics.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
