"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

#: Settings the operators rely on.  Naive timestamps are UTC; skewed join
#: partitions are split even where that costs one more exchange, because any
#: store, game or currency may hold a large share of all rows.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply ``SQL_SETTINGS`` to a session somebody else created; they hold for its later queries, too."""
    for name, value in SQL_SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def build_session(name: str = "pricetide", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, "spark.cleaner.referenceTracking.cleanCheckpoints": "true", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder, which goes
    when the program ends; a cluster that names none is an error, since a
    machine-local folder would be lost with its machine.  No setting is changed.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if not _own:
        _own.append(tempfile.TemporaryDirectory(prefix="pricetide-"))
    return _own[0].name


_own: list[tempfile.TemporaryDirectory] = []
_held: list[DataFrame] = []
_written: list[Stored] = []


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared one, for streaming state and landed tables."""
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def hold(df: DataFrame) -> DataFrame:
    """Mark a table that several steps of one plan read, so that it is computed once.

    Nothing runs until the plan does.  A lost executor's share is computed
    again.  ``release`` gives the space back.
    """
    _held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return df


def keep_written(df: DataFrame) -> DataFrame:
    """Write a small table that several steps read into the shared folder, now; ``release`` deletes it."""
    out = Stored.write(df)
    _written.append(out)
    return out.rows


def release() -> None:
    """Let go of every table held so far."""
    while _held:
        _held.pop().unpersist()
    while _written:
        table = _written.pop()
        delete(table.rows.sparkSession, table.path)


@dataclass(frozen=True)
class Stored:
    """A table of an iteration, written into the shared folder and deleted when the next one stands."""

    rows: DataFrame
    path: str

    @classmethod
    def write(cls, df: DataFrame) -> Stored:
        path = work_dir(df.sparkSession, "round")
        df.write.parquet(path)
        return cls(df.sparkSession.read.schema(df.schema).parquet(path), path)

    def replaced(self, df: DataFrame) -> Stored:
        """``df``, which may read this table, in its place."""
        out = Stored.write(df)
        delete(df.sparkSession, self.path)
        return out

    def settled(self) -> DataFrame:
        """The rows as a checkpoint, which goes with the table that refers to it."""
        out = settle(self.rows)
        delete(out.sparkSession, self.path)
        return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def settle(df: DataFrame) -> DataFrame:
    """Compute one round of an iteration now, into the shared folder, and go on from there.

    Spark's own checkpoint: its files go with the table that refers to them
    when ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on, as
    ``build_session`` has it.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
