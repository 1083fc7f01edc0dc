"""Cutting the lineage of what several later steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> None:
    """Makes sure that there is a checkpoint folder: the session's; in local mode, where spark.checkpoint.dir may be unset, a temporary one."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))


def cut(rows: DataFrame) -> DataFrame:
    """A reliable checkpoint."""
    _folder(rows.sparkSession)
    return rows.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path beside the checkpoints, which driver and executors share."""
    _folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.range(1).checkpoint(eager=True)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """rows, written to a scratch table of Parquet and read again: cut, and of a size that the planner knows."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def bucketed(rows: DataFrame, by: str, tables: list[str]) -> DataFrame:
    """As ``stored``, in as many buckets by a column as shuffles have partitions: joins and groups on it don't move these rows again. The table's name is put to tables, for whoever drops it; its files are scratch."""
    spark = rows.sparkSession
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables.append(f"tessera_{by}_{uuid.uuid4().hex}")
    rows.repartition(many, by).write.bucketBy(many, by).option("path", scratch(spark, "buckets")).saveAsTable(tables[-1])
    return spark.table(tables[-1])


#: Rows that are sent to every task at most.
SENT = 200_000


def sent(rows: DataFrame) -> DataFrame:
    """rows, which are cut and narrow, marked to be sent to every task if they are few; they are counted for that."""
    return F.broadcast(rows) if rows.limit(SENT + 1).count() <= SENT else rows
