"""Held-out material that leaks into training text.

The n-grams of words of the test items are hashed into a set that is broadcast in blocks of a
bounded size; every window of n words of the training text is looked up (a bitmap first, then
binary search), and each hit is verified word for word before it counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import vec
from tallyframe.llm.vec import U64

WORDS = 12
#: Items whose n-grams are broadcast at once; more items go in further passes over the corpus.
BLOCK_ITEMS = 20_000
_BITS = 22


def _item_rows(items: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """(item, text): one row per test item and text column; null texts give none."""
    parts = [items.select(F.col(id_col).alias("item"), F.col(c).cast("string").alias("text")) for c in text_cols]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("text").isNotNull())


class Grams:
    """The n-grams of a block of test texts: sorted hashes, their items, and the words behind them."""

    def __init__(self, rows: list[tuple], n: int):
        self.n = n
        hashes, item, at, words = [], [], [], []
        for ident, text in rows:
            cp, off = vec.decode(*vec.utf8(pa.array([text])))
            cp = vec.lower_table()[cp]
            b, e = vec.words(cp, off)
            if len(b) < n:
                continue
            h = vec.span_hash(vec.prefix_hash(cp), b, e)
            p = vec.prefix_hash(h)
            g = vec.span_hash(p, np.arange(len(b) - n + 1), np.arange(n, len(b) + 1))
            low = [cp[x:y].tobytes() for x, y in zip(b, e)]
            at.append(len(words) + np.arange(len(g)))
            words += low
            hashes.append(g)
            item += [ident] * len(g)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        self.at = np.concatenate(at) if at else np.zeros(0, np.int64)
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.at = self.hash[order], self.at[order]
        self.item = [item[i] for i in order]
        self.words = words
        self.bitmap = np.zeros(1 << _BITS, np.bool_)
        self.bitmap[self.hash >> U64(64 - _BITS)] = True


def find_passages(docs: DataFrame, doc_id: str, text_col: str, items: DataFrame, item_id: str, text_cols: list[str], n: int = WORDS) -> DataFrame:
    """Passages of test items in the texts: (doc_id, item_id, start_pos, end_pos); if both ids have one
    name, the item's is item_<name>.

    A passage is a longest stretch of the document in which every window of `n` words also stands in
    a row in one of the item's text columns; words are runs of letters and digits, case ignored.
    Positions are 0-based characters of the document, the end excluded. Null and empty texts, and
    items of fewer than `n` words, give no row; repeated rows of the corpus are reported each.
    """
    spark, item_name = docs.sparkSession, item_id if item_id != doc_id else f"item_{item_id}"
    kind_d, kind_i = (df.select(c).schema[0].dataType.simpleString() for df, c in ((docs, doc_id), (items, item_id)))
    source = docs.select(F.col(doc_id).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    rows = _item_rows(items, item_id, text_cols)
    blocks = max(1, -(-rows.count() // BLOCK_ITEMS))
    tables = spark.sparkContext.broadcast(vec.packed_tables("class", "lower"))
    schema = f"`{doc_id}` {kind_d}, `{item_name}` {kind_i}, start_pos int, end_pos int"
    out = None
    for k in range(blocks):
        block = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        grams = spark.sparkContext.broadcast(Grams(sorted(map(tuple, block.toLocalIterator()), key=str), n))

        def run(batches: Iterator[pa.RecordBatch], grams=grams) -> Iterator[pa.RecordBatch]:
            vec.unpack_tables(tables.value, "class", "lower")
            for batch in batches:
                for part in vec.slices(batch, "text"):
                    yield _scan(part, grams.value, doc_id, item_name, kind_i)

        found = source.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def _scan(part: pa.RecordBatch, grams: Grams, doc_id: str, item_id: str, kind: str) -> pa.RecordBatch:
    n = grams.n
    rows, items, starts, ends = [], [], [], []
    cp, off = vec.decode(*vec.utf8(part.column("text")))
    if len(grams.hash) and len(cp):
        low = vec._tables["lower"][cp]
        b, e = vec.words(low, off)
        if len(b) >= n:
            p = vec.prefix_hash(vec.span_hash(vec.prefix_hash(low), b, e))
            first = np.arange(len(b) - n + 1)
            g = vec.span_hash(p, first, first + n)
            may = np.flatnonzero(grams.bitmap[g >> U64(64 - _BITS)])
            left = np.searchsorted(grams.hash, g[may], "left")
            right = np.searchsorted(grams.hash, g[may], "right")
            may, left, right = may[right > left], left[right > left], right[right > left]
            doc = np.searchsorted(off, b[may], "right") - 1
            same = np.searchsorted(off, b[may + n - 1], "right") - 1 == doc
            spans: dict[tuple[int, object], list[list[int]]] = {}
            for w, x, y, d in zip(may[same], left[same], right[same], doc[same]):
                text = [low[b[w + i] : e[w + i]].tobytes() for i in range(n)]
                for q in range(x, y):
                    a = grams.at[q]
                    if grams.words[a : a + n] == text:
                        have = spans.setdefault((int(d), grams.item[q]), [])
                        begin, end = int(b[w] - off[d]), int(e[w + n - 1] - off[d])
                        if have and have[-1][2] >= w - 1:
                            have[-1][1:] = [end, int(w)]
                        else:
                            have.append([begin, end, int(w)])
            for (d, i), have in spans.items():
                for begin, end, _ in have:
                    rows.append(d)
                    items.append(i)
                    starts.append(begin)
                    ends.append(end)
    ids = part.column(0).take(pa.array(rows, pa.int32()))
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([ids, pa.array(items, types.get(kind)), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], [doc_id, item_id, "start_pos", "end_pos"])


def clean_documents(docs: DataFrame, passages: DataFrame, doc_id: str, text_col: str, drop_share: float = 0.5) -> DataFrame:
    """The corpus without the passages: (doc_id, clean_text, removed_chars, dropped).

    Spans of a document are united and cut out of its text; a document of which at least
    `drop_share` is leaked is marked dropped, and its clean_text is null. A document without
    passages keeps its text, null included.
    """
    spans = passages.groupBy(F.col(doc_id).alias("_id")).agg(F.array_sort(F.collect_set(F.struct("start_pos", "end_pos"))).alias("_spans"))
    joined = docs.select(F.col(doc_id), F.col(text_col).alias("_text")).join(spans, F.col(doc_id) == F.col("_id"), "left")
    step = F.aggregate(
        "_spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end_pos"]).alias("at"),
            F.concat(a["out"], F.when(s["start_pos"] > a["at"], F.col("_text").substr(a["at"] + 1, s["start_pos"] - a["at"])).otherwise(F.lit(""))).alias("out"),
        ),
    )
    rest = F.concat(step["out"], F.col("_text").substr(step["at"] + 1, F.length("_text")))
    clean = F.when(F.col("_spans").isNull(), F.col("_text")).otherwise(rest)
    out = joined.select(doc_id, clean.alias("clean_text"), (F.length("_text") - F.length(clean)).alias("removed_chars"), F.length("_text").alias("_n"))
    gone = F.coalesce(F.col("removed_chars") >= F.lit(drop_share) * F.greatest("_n", F.lit(1)), F.lit(False))
    return out.select(doc_id, F.when(gone, None).otherwise(F.col("clean_text")).alias("clean_text"), F.coalesce("removed_chars", F.lit(0)).alias("removed_chars"), gone.alias("dropped"))


def _tables(spark: SparkSession, d: str) -> DataFrame:
    items = spark.read.parquet(f"{d}/heldout_items.parquet")
    return find_passages(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text", items, "item_id", ["prompt", "reference"])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and held-out item that share twelve words in a row."""
    return _tables(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its leaked passages."""
    return clean_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), _tables(spark, sf_dir), "doc_id", "text")
