"""Identity: canonical JSON, domain-separated hashes, and the seeded order.

Hashes that need canonical JSON go through one Arrow UDF; the seeded order and the resampling seed
are native expressions. Domains are this package's own.
"""

from __future__ import annotations

import hashlib
import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CASE_DOMAIN, INPUT_DOMAIN = "tallyframe-case-v1", "tallyframe-input-v1"
CONTENT_FIELDS = ["prompt", "output", "reference", "context", "retrieved", "relevance", "metadata", "tags"]
INPUT_FIELDS = ["prompt", "context", "reference", "relevance"]


def _check(value: object, depth: int = 0) -> None:
    if depth > 64:
        raise ValueError("nested too deeply")
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("a number is not finite")
    if isinstance(value, dict):
        for k, v in value.items():
            if not isinstance(k, str):
                raise TypeError("a key is not a string")
            _check(v, depth + 1)
    elif isinstance(value, (list, tuple)):
        for v in value:
            _check(v, depth + 1)
    elif value is not None and not isinstance(value, (str, int, float, bool)):
        raise TypeError(f"{type(value).__name__} has no JSON form")


def canonical_json(value: object) -> str:
    """The one JSON text of a value: sorted keys, ASCII, no blanks; 1 and 1.0 differ; no NaN."""
    _check(value)
    return json.dumps(value, sort_keys=True, ensure_ascii=True, separators=(",", ":"), allow_nan=False)


def stable_hash(domain: str, value: object) -> str:
    return hashlib.sha256(f"{domain}\n{canonical_json(value)}".encode()).hexdigest()


def case_payload(case: dict, fields: list[str]) -> dict:
    """What of a case its hash covers: order of tags doesn't count, that of `retrieved` does; null is not ''."""
    out = {}
    for f in fields:
        v = case.get(f)
        if f == "tags":
            v = sorted(v or [])
        elif f == "metadata":
            v = json.loads(v) if isinstance(v, str) else (v or {})
        elif v is not None and f == "relevance":
            v = {k: int(g) for k, g in (v.items() if isinstance(v, dict) else v)}
        elif v is not None and f == "retrieved":
            v = list(v)
        out[f] = v
    return out


def content_hash(case: dict) -> str:
    return stable_hash(CASE_DOMAIN, case_payload(case, CONTENT_FIELDS))


def input_hash(case: dict) -> str:
    return stable_hash(INPUT_DOMAIN, case_payload(case, INPUT_FIELDS))


def with_case_hashes(cases: DataFrame) -> DataFrame:
    """cases with content_hash and input_hash; missing optional columns count as null."""
    have = [c for c in CONTENT_FIELDS if c in cases.columns]
    packed = F.struct(*[F.map_entries(c).alias(c) if c == "relevance" else F.col(c) for c in have])

    @F.pandas_udf("content_hash string, input_hash string")
    def both(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows.to_dict("records"):
            case = {k: _plain(v) for k, v in r.items()}
            if case.get("relevance") is not None:
                case["relevance"] = {e["key"]: e["value"] for e in case["relevance"]}
            out.append((content_hash(case), input_hash(case)))
        return pd.DataFrame(out, columns=["content_hash", "input_hash"])

    return cases.withColumn("_h", both(packed)).withColumns({"content_hash": F.col("_h.content_hash"), "input_hash": F.col("_h.input_hash")}).drop("_h")


def _plain(v):
    if v is None or isinstance(v, (str, dict)):
        return v
    if hasattr(v, "tolist"):
        return v.tolist()
    return None if isinstance(v, float) and v != v else v


#: Blocks of a dataset's hash: a fixed part of the recipe.
HASH_BLOCKS = 65_536


def dataset_hash(cases: DataFrame) -> str:
    """Hash of `case_key<TAB>content_hash` lines, whatever their order and partitions.

    Lines fall into HASH_BLOCKS blocks by the first 16 bits of their key's sha256; a block's hash is over its lines in
    ascending order, the dataset's over the numbers and hashes of the blocks that have any. Only these reach the driver."""
    line = F.concat_ws("\t", "case_key", "content_hash")
    block = F.conv(F.substring(F.sha2(F.col("case_key"), 256), 1, 4), 16, 10).cast("int")
    blocks = cases.select(block.alias("block"), line.alias("line")).groupBy("block").agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("line"))), 256).alias("h"))
    h = hashlib.sha256()
    for r in sorted((r["block"], r["h"]) for r in blocks.collect()):  # at most HASH_BLOCKS rows
        h.update(f"{r[0]}\t{r[1]}\n".encode())
    return h.hexdigest()


def evaluator_key(kind: str, name: str, version: int, params: dict) -> str:
    digest = hashlib.sha256(canonical_json({"kind": kind, "name": name, "params": params, "version": version}).encode()).hexdigest()
    return f"{kind}:{name}:{digest[:12]}"


def run_hashes(identity: dict, execution: dict) -> tuple[str, str]:
    """(identity_hash, exec_hash): what is measured, and how it was executed."""
    return stable_hash("tallyframe-run-v1", identity), stable_hash("tallyframe-exec-v1", execution)


def cache_key(request: dict, provider: str, model: str, endpoint: str, scope: str) -> str:
    """Key of a response: every field of the request but its timeout."""
    body = {k: v for k, v in request.items() if k != "timeout"}
    return stable_hash("tallyframe-cache-v1", {"endpoint": endpoint, "model": model, "provider": provider, "request": body, "scope": scope})


def rubric_hash(rubric: dict) -> str:
    """Hash of a rubric's content without its label; a must-pass flag that is off doesn't count."""
    criteria = [{k: v for k, v in c.items() if not (k in ("must_pass", "must_pass_floor") and not c.get("must_pass"))} for c in rubric["criteria"]]
    return stable_hash("tallyframe-rubric-v1", {**{k: v for k, v in rubric.items() if k != "version"}, "criteria": criteria})


def _head(text: Column) -> Column:
    """First 8 bytes of the sha256 of a text, as an unsigned number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def seeded_order(seed: int, key: Column) -> Column:
    """63-bit processing order of a key: a sample of n is a prefix of every larger sample."""
    return F.floor(_head(F.concat(F.lit(str(seed)), F.char(F.lit(0)), key)) / 2).cast("long")


def metric_seed(seed: int, key: Column, name: Column) -> Column:
    """Seed of a metric's resampling, an unsigned 64-bit number."""
    return _head(F.concat_ws("|", F.lit(str(seed)), key, name))
