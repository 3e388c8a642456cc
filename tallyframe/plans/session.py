"""Settings that the operators rely on, set on the session they are given."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: A union that keeps its inputs' partitioning fails in Spark 4.1 ("Can't zip RDDs with unequal numbers
#: of partitions") when adaptive execution gives the inputs different numbers of partitions.
SETTINGS = {"spark.sql.unionOutputPartitioning": "false"}


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once per application, unless PYTHONPATH has it already."""
    root, app = str(Path(__file__).resolve().parents[2]), spark.sparkContext.applicationId
    if app in _shipped or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _shipped.add(app)
    folder = tempfile.mkdtemp(prefix="tallyframe-package-")
    atexit.register(shutil.rmtree, folder, True)  # executors fetch it from the driver when they start
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/tallyframe", "zip", root, "tallyframe"))


def prepare(spark: SparkSession) -> SparkSession:
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    ship(spark)
    return spark


def prepared(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query on a session with the settings."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(prepare(spark), sf_dir)

    return run
