"""Datasets of cases: strict JSONL in, immutable content-hashed versions, JSONL out."""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import hashing, strictjson

NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}")
MAX_LINE, MAX_FIELD, MAX_CASE, MAX_METADATA, MAX_TAGS, MAX_CASES, MAX_ISSUES = 4 << 20, 256 << 10, 1 << 20, 16 << 10, 32, 5_000_000, 100
CASE = "case_key string, prompt string, output string, reference string, context string, retrieved array<string>, relevance map<string,int>, metadata string, tags array<string>"
_FIELDS = [f.split(" ")[0] for f in re.split(r", (?=[a-z_]+ )", CASE)]


def _parse(line: str) -> tuple[dict | None, str | None]:
    try:
        v = strictjson.loads(line)
    except ValueError as e:
        return None, f"not strict JSON: {e}"[:200]
    if not isinstance(v, dict):
        return None, "not an object"
    unknown = v.keys() - set(_FIELDS)
    if unknown:
        return None, f"unknown fields {sorted(unknown)}"[:200]
    for f in ("case_key", "prompt", "output", "reference", "context"):
        if not isinstance(v.get(f), str) and not (v.get(f) is None and f not in ("case_key", "prompt")):
            return None, f"{f} is not a text"
    if not v["case_key"]:
        return None, "case_key is empty"
    for f in ("retrieved", "tags"):
        if v.get(f) is not None and not (isinstance(v[f], list) and all(isinstance(x, str) for x in v[f])):
            return None, f"{f} is not a list of texts"
    rel = v.get("relevance")
    if rel is not None and not (isinstance(rel, dict) and all(isinstance(g, int) and not isinstance(g, bool) and 0 <= g <= 100 for g in rel.values())):
        return None, "relevance is not a map of whole grades from 0 to 100"
    if not isinstance(v.get("metadata") or {}, dict):
        return None, "metadata is not an object"
    try:
        meta = hashing.canonical_json(v.get("metadata") or {})
    except (ValueError, TypeError) as e:
        return None, f"metadata: {e}"
    tags = list(dict.fromkeys(v.get("tags") or []))
    return {**{f: v.get(f) for f in _FIELDS}, "metadata": meta, "tags": tags}, None


def read_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases, rejects) of JSONL files; rejects are (file, line, error).

    Strict: UTF-8, no duplicate keys, no NaN, no unknown fields. Blank lines are skipped; a line over 4 MiB
    is rejected unread. Lines are numbered per file: a count of lines per split, then numbers within
    splits, so that a file is never in one task."""
    raw = spark.read.format("text").load(path).select(F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    raw = raw.withColumn("at", F.monotonically_increasing_id())
    counts = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    from pyspark.sql import Window

    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("file", "block", "first", "before")  # a row per split
    lines = raw.join(before, ["file", "block"]).withColumn("line", F.col("at") - F.col("first") + F.col("before") + 1).where(~F.col("value").rlike(r"\A\s*\z"))
    short = F.octet_length("value") <= MAX_LINE
    lines = lines.withColumn("bad", F.when(~short, "line too long").when(~F.is_valid_utf8("value"), "not UTF-8")).withColumn("value", F.when(F.col("bad").isNull(), F.col("value")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for v, file, line, bad in zip(pdf["value"], pdf["file"], pdf["line"], pdf["bad"]):
                case, error = (None, bad) if bad else _parse(v)
                out.append({"case": case, "file": file, "line": line, "error": error})
            yield pd.DataFrame(out, columns=["case", "file", "line", "error"])

    parsed = lines.select("value", "file", "line", "bad").mapInPandas(run, f"case struct<{CASE.replace(' ', ':').replace(',:', ',')}>, file string, line bigint, error string")
    return parsed.where("error is null").select("case.*"), parsed.where("error is not null").select("file", "line", "error")


def violations(cases: DataFrame) -> Column:
    """The limits a case breaks, as an array of names."""
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    total = size("prompt") + size("output") + size("reference") + size("context") + size("metadata")
    checks = [F.when(size(f) > MAX_FIELD, f"{f}_too_large") for f in ("prompt", "output", "reference", "context") if f in cases.columns]
    checks += [F.when(total > MAX_CASE, "case_too_large"), F.when(size("metadata") > MAX_METADATA, "metadata_too_large"), F.when(F.size("tags") > MAX_TAGS, "too_many_tags"), F.when(F.coalesce(F.length("case_key"), F.lit(0)) == 0, "no_case_key"), F.when(F.col("prompt").isNull(), "no_prompt")]
    return F.array_compact(F.array(*checks))


def validate(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, issues): issues are (case_key, violation); repeated keys are violations of all their rows."""
    checked = cases.withColumn("_v", violations(cases))
    twice = cases.groupBy("case_key").agg(F.count("*").alias("c")).where("c > 1").select("case_key", F.lit("duplicate_key").alias("violation"))
    issues = checked.select("case_key", F.explode("_v").alias("violation")).unionByName(twice)
    return checked.where(F.size("_v") == 0).drop("_v").join(twice.select("case_key"), "case_key", "left_anti"), issues


class DatasetStore:
    """Versions of datasets as parquet: <root>/<name>/v<no>/cases, and a manifest that makes a version visible.

    The root is a folder of the driver's file system that executors share; max_cases bounds a version."""

    def __init__(self, spark: SparkSession, root: str, max_cases: int = MAX_CASES):
        self.spark, self.root, self.max_cases = spark, root, max_cases

    def _manifests(self) -> list[dict]:
        out = []
        for name in sorted(os.listdir(self.root)) if os.path.isdir(self.root) else []:
            for v in os.listdir(f"{self.root}/{name}"):
                p = f"{self.root}/{name}/{v}/manifest.json"
                if os.path.exists(p):
                    out.append(json.load(open(p)))
        return sorted(out, key=lambda m: (m["name"], m["version_no"]))

    def versions(self, name: str | None = None) -> list[dict]:
        return [m for m in self._manifests() if name in (None, m["name"])]

    def datasets(self) -> list[dict]:
        """Every dataset with its number of versions and its latest."""
        out: dict[str, dict] = {}
        for m in self._manifests():
            d = out.setdefault(m["name"], {"name": m["name"], "versions": 0, "latest": 0})
            d["versions"] += 1
            d["latest"] = max(d["latest"], m["version_no"])
        return list(out.values())

    def resolve(self, ref: str) -> dict:
        """`name`, `name@latest`, `name@<number>` or `name@<hash prefix of 8 or more>`; digits are a number first."""
        name, _, want = ref.partition("@")
        own = self.versions(name)
        if not own:
            raise LookupError(f"no dataset {name}")
        if want in ("", "latest"):
            return own[-1]
        hits = [m for m in own if want.isdigit() and m["version_no"] == int(want)] or [m for m in own if len(want) >= 8 and m["content_hash"].startswith(want)]
        if len(hits) != 1:
            raise LookupError(f"{ref}: {'ambiguous' if hits else 'no such version'}")
        return hits[0]

    def import_cases(self, name: str, cases: DataFrame, rejects: DataFrame | None = None) -> tuple[dict, bool]:
        """(version, created): all cases or none. The same content gives the version there is."""
        if not NAME.fullmatch(name):
            raise ValueError(f"{name!r} is no dataset name")
        staged = f"{self.root}/.staging-{uuid.uuid4().hex}"
        try:
            valid, issues = validate(cases)
            bad = [tuple(r) for r in issues.limit(MAX_ISSUES).collect()]
            bad += [tuple(r) for r in rejects.limit(MAX_ISSUES).collect()] if rejects is not None else []
            if bad:
                raise ValueError(f"refused: {bad[:MAX_ISSUES]}")
            hashing.with_case_hashes(valid).write.parquet(staged)
            stored = self.spark.read.parquet(staged)
            n = stored.count()
            if not 1 <= n <= self.max_cases:
                raise ValueError(f"{n} cases")
            digest = hashing.dataset_hash(stored)
            for m in self.versions(name):
                if m["content_hash"] == digest:
                    return m, False
            no = max([m["version_no"] for m in self.versions(name)] or [0]) + 1
            m = {"name": name, "version_no": no, "content_hash": digest, "n_cases": n}
            path = f"{self.root}/{name}/v{no}"
            os.makedirs(path)
            os.rename(staged, f"{path}/cases")
            with open(f"{path}/manifest.tmp", "w") as f:
                json.dump(m, f)
            os.rename(f"{path}/manifest.tmp", f"{path}/manifest.json")  # sealed
            return m, True
        finally:
            shutil.rmtree(staged, ignore_errors=True)

    def import_jsonl(self, name: str, path: str) -> tuple[dict, bool]:
        cases, rejects = read_jsonl(self.spark, path)
        return self.import_cases(name, cases, rejects)

    def cases(self, ref: str) -> DataFrame:
        m = self.resolve(ref)
        return self.spark.read.parquet(f"{self.root}/{m['name']}/v{m['version_no']}/cases")

    def case(self, ref: str, key: str) -> DataFrame:
        return self.cases(ref).where(F.col("case_key") == key)

    def verify(self, ref: str) -> list[str]:
        """What does not fit a version's manifest: counts, case hashes, the dataset's hash."""
        m, cases = self.resolve(ref), self.cases(ref)
        again = hashing.with_case_hashes(cases.drop("content_hash", "input_hash")).select("case_key", F.col("content_hash").alias("c"), F.col("input_hash").alias("i"))
        wrong = cases.join(again, "case_key").where("content_hash <> c or input_hash <> i").count()
        out = ["count"] if cases.count() != m["n_cases"] else []
        out += ["case_hash"] if wrong else []
        return out + (["dataset_hash"] if hashing.dataset_hash(cases) != m["content_hash"] else [])

    def export_jsonl(self, ref: str, path: str) -> int:
        """Writes the cases in ascending order of their keys; checks every hash; refuses a file that exists.

        Lines are made and checked by the executors and sorted over the cluster; their files are joined in order, as
        bytes, by the driver."""
        if os.path.exists(path):
            raise FileExistsError(path)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for case in pdf.to_dict("records"):
                    case = {k: hashing._plain(v) for k, v in case.items()}
                    case["relevance"] = {k: int(v) for k, v in (dict(case["relevance"]) if case.get("relevance") is not None else {}).items()} if case.get("relevance") is not None else None
                    if hashing.content_hash(case) != case["content_hash"]:
                        raise ValueError(f"{case['case_key']}: the content does not fit its hash")
                    body = {k: case[k] for k in _FIELDS if case.get(k) is not None}
                    body["metadata"] = json.loads(body.get("metadata") or "{}")
                    out.append(json.dumps({k: v for k, v in body.items() if v not in ({}, []) or k in ("retrieved", "relevance")}, ensure_ascii=False))
                yield pd.DataFrame({"case_key": pdf["case_key"], "value": out})

        cases, staged = self.cases(ref), f"{self.root}/.staging-{uuid.uuid4().hex}"
        try:
            lines = cases.mapInPandas(run, "case_key string, value string").orderBy("case_key").select("value")
            lines.write.option("lineSep", "\n").text(staged)
            with open(path + ".tmp", "wb") as f:
                for part in sorted(x for x in os.listdir(staged) if x.startswith("part-")):
                    with open(f"{staged}/{part}", "rb") as g:
                        shutil.copyfileobj(g, f)
        finally:
            shutil.rmtree(staged, ignore_errors=True)
        os.rename(path + ".tmp", path)
        return self.resolve(ref)["n_cases"]
