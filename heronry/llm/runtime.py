"""Reading tables and cutting lineage in the folder that all executors share."""

from __future__ import annotations

import gc

from pyspark.sql import SparkSession

from heronry.session import forgotten, forgotten_at_exit, settled, shared_dir, table, written

__all__ = ["forgotten", "forgotten_at_exit", "released", "settled", "shared_dir", "table", "written"]


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; by itself it does so
    only when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
