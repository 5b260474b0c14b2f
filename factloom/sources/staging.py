"""Tables written in the folder that driver and executors share, which cut lineage: a lost executor costs one step."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a machine-local folder only in local mode, where none is configured."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Bytes of files up to which a table is broadcast for its files' size alone.
SURE = 1 << 16


@contextlib.contextmanager
def real_sizes(spark: SparkSession) -> Iterator[None]:
    """Inside, a join's side of more than ``SURE`` bytes on disk is broadcast only if its rows turn out small when they are shuffled.

    Files are compressed: names in order take 90 times as much in memory, and a broadcast passes the driver.
    """
    planned, found = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    most = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    before = {n: spark.conf.get(n, None) for n in (planned, found)}
    spark.conf.set(planned, str(min(most, SURE)))
    if before[found] is None:
        spark.conf.set(found, str(most))
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


class Staging:
    """Written tables of one run, each under its own name."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.count = spark, 0
        self.root = f"{shared_folder(spark)}/factloom/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns the reader of what was written."""
        self.count += 1
        path = f"{self.root}/{self.count}-{name}"
        with real_sizes(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
