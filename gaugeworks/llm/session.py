"""What the text operators need of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from gaugeworks.shipping import ship

ARROW_ROWS = 2000
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Give the package to the Python workers, and bound their batches: texts are long, and a batch is in memory on both sides.

    A smaller bound of the session stays. Results are lazy, so the bound must outlast this call."""
    ship(spark)
    now = int(spark.conf.get(_SETTING))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(_SETTING, str(ARROW_ROWS))
