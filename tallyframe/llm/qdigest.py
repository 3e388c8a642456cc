"""Percentiles of very large numeric columns from mergeable digests with a deterministic rank error.

A value is quantized to 32 bits whose order is the order of single-precision numbers. A digest holds
counts of nodes of the dyadic tree over these codes; a node, its sibling and its parent whose counts
together stay within n / k go into the parent. Digests are merged by adding counts node by node. A
percentile read from a digest of n values is off by at most 32 * floor(n / k) ranks, also after any
number of merges, and by single-precision rounding (2**-24 of the value) besides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.shared import written

BITS = 32
#: Rank error of a percentile as a share of the number of values.
ERROR = 0.005
#: Nodes that a task holds before it compresses its digests, and buckets in which the digests of tasks, or of
#: further keys such as days, are merged before they are merged into one.
HELD, FAN_IN = 1_000_000, 64
NODE = "metric string, level int, node bigint, n bigint"
RESERVED = {"metric", "level", "node", "n", "bucket", "max_rank_error"}


def codes_of(values: np.ndarray) -> np.ndarray:
    """Order-preserving 32-bit codes; 0.0 and -0.0 have one code."""
    b = (values.astype(np.float32) + np.float32(0)).view(np.uint32).astype(np.int64)
    return np.where(b >> 31, 0xFFFFFFFF - b, b + 0x80000000)


def values_of(codes: np.ndarray) -> np.ndarray:
    b = np.where(codes >= 0x80000000, codes - 0x80000000, 0xFFFFFFFF - codes).astype(np.uint32)
    return b.view(np.float32).astype(np.float64)


def _sum_by(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, back = np.unique(keys, return_inverse=True)
    return u, np.bincount(back, weights=n, minlength=len(u)).astype(np.int64)


def compress(level: np.ndarray, node: np.ndarray, n: np.ndarray, error: float = ERROR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The digest of these nodes: equal nodes added, light families moved to their parents."""
    limit = int(n.sum() // np.ceil(BITS / error))
    if not limit:  # too few values for any family to be light
        both, c = _sum_by((level.astype(np.int64) << BITS) | node, n)
        return both >> BITS, both & ((1 << BITS) - 1), c
    out: list[tuple[int, np.ndarray, np.ndarray]] = []
    up, up_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for k in range(BITS + 1):
        own = level == k
        x, c = _sum_by(np.concatenate([node[own], up]), np.concatenate([n[own], up_n]))
        up, up_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if limit and k < BITS and len(x):
            parent, total = _sum_by(x >> 1, c)
            above = level == k + 1
            p, pc = _sum_by(node[above], n[above])
            at = np.minimum(np.searchsorted(p, parent), max(len(p) - 1, 0))
            have = np.where(p[at] == parent, pc[at], 0) if len(p) else np.zeros(len(parent), np.int64)
            light = total + have <= limit
            up, up_n = parent[light], total[light]
            keep = ~light[np.searchsorted(parent, x >> 1)]
            x, c = x[keep], c[keep]
        if len(x):
            out.append((k, x, c))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([np.full(len(x), k) for k, x, _ in out]), np.concatenate([x for _, x, _ in out]), np.concatenate([c for _, _, c in out])


def _key_columns(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows (key values, metric, levels, nodes, counts) as one batch, the task's number with every node."""
    n = [len(r[2]) for r in rows]
    each = pa.array(np.repeat(np.arange(len(rows)), n))
    cols = [pa.array([r[0][i] for r in rows], schema.field(i).type).take(each) for i in range(len(rows[0][0]))]
    cols.append(pa.array([r[1] for r in rows], pa.string()).take(each))
    for j, kind in ((2, np.int32), (3, np.int64), (4, np.int64)):
        cols.append(pa.array(np.concatenate([r[j] for r in rows]).astype(kind)))
    cols.append(pa.array(np.full(len(each), TaskContext.get().partitionId(), np.int32)))
    return pa.RecordBatch.from_arrays(cols, schema=schema)


def _grouped(df: DataFrame, by: list[str], then: list[str], run: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """`run` over whole groups of `by`, many at once: it gets a table ordered by `by` and `then`, and where each group begins."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def starts(t: pa.Table) -> np.ndarray:
            new = np.zeros(t.num_rows, np.bool_)
            new[:1] = True
            for c in by:
                code = t.column(c).combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            return np.flatnonzero(new)

        rows = seen = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 2 * seen:  # one group that goes on: it is looked at again when it has doubled
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            at = starts(t)
            last = int(at[-1])
            if last:
                yield from run(t.slice(0, last), at[:-1]).combine_chunks().to_batches()
            held = t.slice(last).to_batches()
            rows = seen = t.num_rows - last
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from run(t, starts(t)).combine_chunks().to_batches()

    return df.repartition(*by).sortWithinPartitions(*by, *then).mapInArrow(stream, schema)


def digest(df: DataFrame, keys: list[str], columns: list[str], error: float = ERROR) -> DataFrame:
    """Digests of numeric columns per group: (*keys, metric, level, node, n).

    Nulls and NaN are no values; a group without values has no rows; a null key is a group. Every
    task digests its own rows first. The digests are merged in FAN_IN buckets of tasks and then into
    one, at every size: a task reads no more of a group than a FAN_IN-th of the tasks' digests, then FAN_IN.
    """
    if set(keys) & RESERVED:
        raise ValueError(f"a key is named as a column of the digest: {sorted(set(keys) & RESERVED)}")
    source = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        size, kinds = 0, None

        def squeeze() -> int:
            for key, parts in held.items():
                held[key] = [compress(*map(np.concatenate, zip(*parts)), error)]
            return sum(len(v[0][2]) for v in held.values())

        def emitted() -> Iterator[pa.RecordBatch]:
            squeeze()
            rows = [(key, metric, *v[0]) for (key, metric), v in held.items()]
            held.clear()
            if rows:
                yield _batch(rows, pa.schema([*kinds, ("metric", pa.string()), ("level", pa.int32()), ("node", pa.int64()), ("n", pa.int64()), ("bucket", pa.int32())]))

        for batch in batches:
            kinds = [batch.schema.field(i) for i in range(len(keys))]
            if not batch.num_rows:
                continue
            index = np.zeros(batch.num_rows, np.int64)
            values = []
            for i in range(len(keys)):
                enc = batch.column(i).dictionary_encode("encode")
                values.append(enc.dictionary.to_pylist())
                index = index * len(enc.dictionary) + enc.indices.to_numpy(zero_copy_only=False)
            groups, back = np.unique(index, return_inverse=True)
            order = np.argsort(back, kind="stable")
            ends = np.append(0, np.cumsum(np.bincount(back)))
            for j, metric in enumerate(columns):
                x = batch.column(len(keys) + j).to_numpy(zero_copy_only=False)
                codes, ok = codes_of(np.nan_to_num(x, nan=0.0, posinf=np.inf, neginf=-np.inf)), ~np.isnan(x)
                for g, group in enumerate(groups):
                    at = order[ends[g] : ends[g + 1]]
                    at = at[ok[at]]
                    if not len(at):
                        continue
                    key, rest = [], int(group)
                    for v in reversed(values):
                        key.append(v[rest % len(v)])
                        rest //= len(v)
                    held.setdefault((tuple(reversed(key)), metric), []).append((np.zeros(len(at), np.int64), codes[at], np.ones(len(at), np.int64)))
                    size += len(at)
            if size > HELD:
                size = squeeze()
                if 2 * size > HELD:  # so many groups that they are not held to the end
                    yield from emitted()
                    size = 0
        yield from emitted()

    parts = source.mapInArrow(run, f"{_key_columns(source, keys)}{NODE}, bucket int")
    return _merge(parts.withColumn("bucket", F.pmod("bucket", F.lit(FAN_IN))), keys, error)


def _merge(nodes: DataFrame, keys: list[str], error: float) -> DataFrame:
    """One digest per group of `keys`, by way of one per group and bucket."""

    def run(t: pa.Table, at: np.ndarray, names: list[str]) -> pa.Table:
        n = t.column("n").to_numpy()
        size = np.diff(np.append(at, t.num_rows))
        group = np.repeat(np.arange(len(at)), size)
        level, node = t.column("level").to_numpy().astype(np.int64), t.column("node").to_numpy()
        # Groups whose nodes are too light for any family to be moved only have equal nodes added.
        heavy = np.add.reduceat(n, at) >= np.ceil(BITS / error)
        light = np.flatnonzero(~heavy[group])
        new = np.append(True, (group[light][1:] != group[light][:-1]) | (level[light][1:] != level[light][:-1]) | (node[light][1:] != node[light][:-1]))[: len(light)]
        first = np.flatnonzero(new)
        parts = [(group[light][first], level[light][first], node[light][first], np.add.reduceat(n[light], first) if len(first) else n[:0])]
        for g in np.flatnonzero(heavy):
            own = slice(at[g], at[g] + size[g])
            c = compress(level[own], node[own], n[own], error)
            parts.append((np.full(len(c[2]), g), *c))
        g, level, node, n = (np.concatenate(x) for x in zip(*parts))
        cols = [t.column(c).combine_chunks().take(pa.array(at[g])) for c in names]
        return pa.table([*cols, pa.array(level.astype(np.int32)), pa.array(node), pa.array(n)], names=[*names, "level", "node", "n"])

    out = nodes
    for by in ([*keys, "bucket"], list(keys)):
        names = [*by, "metric"]
        bucket = "bucket int, " if "bucket" in by else ""
        out = _grouped(out.select(*names, "level", "node", "n"), names, ["level", "node"], partial(run, names=names), f"{_key_columns(nodes, keys)}{bucket}{NODE}")
    return out


def merge(nodes: DataFrame, keys: list[str], error: float = ERROR) -> DataFrame:
    """Digests of all rows with the same `keys`, from digests with these and further keys, or of several tables united.

    The digests of the further keys (days, say) are merged in FAN_IN buckets by their values and then into one."""
    further = [c for c in nodes.columns if c not in keys and c not in ("metric", "level", "node", "n")]
    bucket = F.pmod(F.xxhash64(*further) if further else F.xxhash64("node"), F.lit(FAN_IN)).cast("int")
    return _merge(nodes.withColumn("bucket", bucket), keys, error)


def percentiles(nodes: DataFrame, keys: list[str], percents: list[int], error: float = ERROR) -> DataFrame:
    """(*keys, metric, n, p<percent>..., max_rank_error) of every digest: p is a value whose rank lies
    between ceil(n * percent / 100) and that plus max_rank_error. A group of fewer than 32 / error values
    has no light family, so its digest is every value and its error 0."""
    names = [f"p{p}" for p in percents]
    schema = f"{_key_columns(nodes, keys)}metric string, n bigint, {', '.join(f'{x} double' for x in names)}, max_rank_error bigint"
    by = [*keys, "metric"]

    def run(t: pa.Table, at: np.ndarray) -> pa.Table:
        top, n = t.column("top").to_numpy(), t.column("n").to_numpy()
        upto, total = np.cumsum(n), np.add.reduceat(n, at)
        before = upto[at] - n[at]
        got = [values_of(top[np.searchsorted(upto, before + np.maximum(1, -(-total * p // 100)))]) for p in percents]
        bound = BITS * (total // int(np.ceil(BITS / error)))
        cols = [t.column(c).combine_chunks().take(pa.array(at)) for c in by]
        return pa.table([*cols, pa.array(total), *map(pa.array, got), pa.array(bound)], names=[*by, "n", *names, "max_rank_error"])

    top = F.expr("shiftleft(node + 1, level) - 1")
    return _grouped(nodes.select(*by, "level", "n", top.alias("top")), by, ["top", "level"], run, schema)


PERCENTS = [10, 25, 50, 75, 90, 95, 99]


def _evaluations(spark: SparkSession, d: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/evaluations.parquet").select("id", "judge_model", F.date_format("created_at", "yyyy-MM-dd").alias("day"), "latency_ms", "overall_score")
    return df.dropDuplicates(["id"])


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of latency and score per judge model: of every single day, and with a null day of all
    days, combined from the digests of the days."""
    columns = ["latency_ms", "overall_score"]
    days = written(digest(_evaluations(spark, sf_dir), ["judge_model", "day"], columns))
    whole = merge(days, ["judge_model"]).withColumn("day", F.lit(None).cast("string"))
    return percentiles(days.where("day is not null").unionByName(whole), ["judge_model", "day"], PERCENTS)


ORACLE = {
    "p1_percentiles": f"""
        WITH e AS (SELECT id, any_value(judge_model) AS judge_model, strftime(any_value(created_at), '%Y-%m-%d') AS day, any_value(latency_ms)::DOUBLE AS latency_ms, any_value(overall_score) AS overall_score FROM evaluations GROUP BY id),
        d AS (SELECT judge_model, day, latency_ms, overall_score FROM e WHERE day IS NOT NULL UNION ALL SELECT judge_model, NULL, latency_ms, overall_score FROM e),
        v AS (SELECT judge_model, day, 'latency_ms' AS metric, latency_ms AS v FROM d UNION ALL SELECT judge_model, day, 'overall_score', overall_score FROM d),
        r AS (SELECT judge_model, day, metric, v::FLOAT::DOUBLE AS v, row_number() OVER w AS k, count(*) OVER (PARTITION BY judge_model, day, metric) AS n FROM v WHERE v IS NOT NULL AND NOT isnan(v)
            WINDOW w AS (PARTITION BY judge_model, day, metric ORDER BY v))
        SELECT judge_model, day, metric, n, {', '.join(f'max(CASE WHEN k = (n * {p} + 99) // 100 THEN v END) AS p{p}' for p in PERCENTS)},
            ({BITS} * (n // {int(np.ceil(BITS / ERROR))}))::BIGINT AS max_rank_error FROM r GROUP BY judge_model, day, metric, n"""
}
