"""What every operator with Python workers needs: bounded Arrow batches and this package on the executors."""

from __future__ import annotations

from pyspark.sql import SparkSession

from sparkloom.plans.shipping import ship

ROWS, BYTES = 512, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """At most 512 rows or 16 MB to a batch (one row at least): texts can be very long."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES))
