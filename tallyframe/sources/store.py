"""Append-only tables of facts as parquet, idempotent replay of spilled results, and configuration files."""

from __future__ import annotations

import json
import os
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import strictjson


class FactStore:
    """<root>/<table>/ as parquet, partitioned by run where the table has runs. Rows are only ever added.

    Executors write; a task tried again writes the same rows once, by Spark's commit. `replay` adds
    what is not there yet, so that spilled results can be played again any number of times."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def exists(self, table: str) -> bool:
        """Whether the table holds any file; one to which only empty results were added does not."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path(table)}/*")
        found = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
        return any(f.getPath().getName()[0] not in "_." for f in found or ())

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(table))

    def append(self, table: str, rows: DataFrame) -> None:
        w = rows.write.mode("append")
        (w.partitionBy("run_id") if "run_id" in rows.columns else w).parquet(self.path(table))

    def drop(self, table: str) -> bool:
        """Removes a table that can be made again, such as the cache; whether there was one."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(table))
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def replay(self, table: str, rows: DataFrame, keys: list[str]) -> int:
        """Adds the rows whose keys are not in the table yet; their number."""
        new = rows.dropDuplicates(keys)
        if self.exists(table):
            new = new.join(self.read(table).select(*keys).distinct(), keys, "left_anti")
        new = new.cache()
        n = new.count()
        if n:
            self.append(table, new)
        new.unpersist()
        return n

    def spill(self, rows: DataFrame, path: str) -> None:
        """Results that could not be stored, as JSON lines beside the store."""
        rows.write.mode("append").json(path)

    def bind_label(self, label: str, content_hash: str) -> None:
        """Binds a rubric's label to its content for good; the same content again is no error."""
        if self.exists("rubric_versions"):
            other = self.read("rubric_versions").where((F.col("label") == label) & (F.col("content_hash") != content_hash))
            if not other.isEmpty():
                raise ValueError(f"label {label} means another rubric")
            if not self.read("rubric_versions").where(F.col("label") == label).isEmpty():
                return
        self.append("rubric_versions", self.spark.createDataFrame([(label, content_hash)], "label string, content_hash string"))


#: Statuses a run may go to (fixed values of this package).
TRANSITIONS = {"created": {"running"}, "running": {"succeeded", "partial", "cancelled", "failed"}, "partial": {"running"}, "cancelled": {"running"}, "failed": {"running"}, "succeeded": {"running"}}


def check_transition(before: str, after: str, retry_of: str | None = None) -> None:
    """Refuses a step that no run takes; a succeeded run goes on only for a retry that names what it retries."""
    if after not in TRANSITIONS.get(before, set()) or before == "succeeded" and not retry_of:
        raise ValueError(f"a run does not go from {before} to {after}")


def list_evaluations(evaluations: DataFrame, tag: str | None = None, limit: int = 50) -> DataFrame:
    """Single evaluations, newest first, with a tag if one is given."""
    rows = evaluations if tag is None else evaluations.where(F.array_contains(F.from_json("tags_json", "array<string>"), tag))
    return rows.orderBy(F.desc("created_at"), "id").limit(limit)


def list_runs(runs: DataFrame, version: str | None = None, status: str | None = None, limit: int = 100) -> DataFrame:
    if not 1 <= limit <= 10_000:
        raise ValueError("limit is from 1 to 10000")
    rows = runs if version is None else runs.where(F.col("dataset_version_id") == version)
    rows = rows if status is None else rows.where(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), "id").limit(limit)


def load_config(path: str, keys: set[str]) -> dict:
    """A TOML or JSON file with no keys but these."""
    with open(path, "rb") as f:
        raw = f.read()
    config = tomllib.loads(raw.decode()) if path.endswith(".toml") else strictjson.loads(raw)
    if not isinstance(config, dict) or config.keys() - keys:
        raise ValueError(f"{os.path.basename(path)}: unknown keys {sorted(config.keys() - keys) if isinstance(config, dict) else ''}")
    return config


def load_prices(spark: SparkSession, path: str) -> DataFrame:
    """prices (provider, model, input_per_mtok, output_per_mtok, price_version) of a price file."""
    config = load_config(path, {"version", "currency", "models"})
    rows = [(m["provider"], m["model"], float(m["input_per_mtok"]), float(m["output_per_mtok"]), str(config["version"])) for m in config["models"]]
    if len({r[:2] for r in rows}) != len(rows) or any(not 0 <= x < 1e9 for r in rows for x in r[2:4]):
        raise ValueError("a model is listed twice, or a price is out of range")
    return spark.createDataFrame(rows, "provider string, model string, input_per_mtok double, output_per_mtok double, price_version string")


class EventLog:
    """One JSON line per event, with scalar fields of known names only."""

    FIELDS = {"run_id", "status", "stop_reason", "n", "wave", "total", "complete", "failed", "seconds", "table", "evaluator_key", "round", "stage"}

    def __init__(self, path: str | None = None):
        self.path, self.events = path, []

    def emit(self, event: str, **fields) -> None:
        row = {"event": event, **{k: v for k, v in fields.items() if k in self.FIELDS and (v is None or isinstance(v, (str, int, float, bool)))}}
        self.events.append(row)
        if self.path:
            with open(self.path, "a") as f:
                f.write(json.dumps(row) + "\n")
