"""A session for local work; on a cluster, use the cluster's own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "4g") -> SparkSession:
    # workers run side by side, so numpy's own threads would only get in their way
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    conf = {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cores}]").appName("spillway").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
