"""How the operators of this subpackage keep intermediate tables and their checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset and the master is local, as in
    tests, a folder of this machine; elsewhere that would lose rows, so it is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that the executors of {master} share")
        if "d" not in _local:
            _local["d"] = tempfile.mkdtemp(prefix="tallyframe-")
            atexit.register(shutil.rmtree, _local["d"], True)
        d = f"file://{_local['d']}"
    return d.rstrip("/")


_written: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read from there: no lineage, sizes known to the planner.

    The table outlives the call, because the result that reads it is lazy. `drop` deletes one that nothing will read
    again, such as a round that the next one has replaced; `forget` deletes all.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tallyframe_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that `written` gave; whatever was to be made of them must have been written before."""
    for t in tables:
        _delete(t.sparkSession, t._tallyframe_path)
        _written.remove(t._tallyframe_path)


def forget(spark: SparkSession) -> None:
    """Deletes the tables of `written`; results not yet taken can't be taken afterwards."""
    while _written:
        _delete(spark, _written.pop())
