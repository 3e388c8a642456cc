"""Long spans that stand word for word in more than one text.

Every stretch of `length` characters holds a sample: the k-gram with the least hash of the stretch
(two texts that share the stretch share the sample, so none is lost). Samples that only one text
has are dropped; around every other one the text that can hold such a stretch is cut out, equal
pieces become one class, and the classes of one sample meet in one shard. A shard is a compressed FM-index over
its classes; they are streamed through it, and every occurrence of a window of `length` characters is
reported and extended to its full span. A class that several texts have is found in itself. So every
shared span comes from the index, and texts follow from the members of its classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import vec
from tallyframe.llm.fmindex import FMIndex, extend
from tallyframe.llm.shared import written

LENGTH, GRAM = 400, 200
#: Characters that one FM-index holds at most, beyond those of a single block of pieces.
SHARD_CHARS = 1_500_000
#: Distinct pieces of one sample that meet in one block; a larger group is taken in pairs of blocks.
GROUP_BLOCK = 256
#: Members of a class that one task takes on one side of a pair.
MEMBERS = 2000
#: Bits of the filter over documents that have a shared sample: a fixed size, however many there are.
FILTER_BITS = 1 << 23


def _samples(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, doc, pos): the samples of every text of at least `length` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = length - gram + 1
        for batch in batches:
            for part in vec.slices(batch, "text"):
                cp, off = vec.decode(*vec.utf8(part.column("text")))
                size = np.diff(off)
                long = np.flatnonzero(size >= length)
                if not len(long):
                    continue
                at = np.arange(len(cp) - gram + 1)
                h = vec.span_hash(vec.prefix_hash(cp), at, at + gram)
                least = vec.window_min(h, w)
                inside = np.zeros(len(least), np.bool_)
                inside[vec.ragged(off[long], size[long] - length + 1)] = True
                first = np.flatnonzero(inside & np.append(True, (least[1:] != least[:-1]) | ~inside[:-1]))
                # A window's least gram enters at its right end, or stood in the window when it began.
                pos = first + w - 1
                other = h[pos] != least[first]
                pos[other] = [i + int(h[i : i + w].argmin()) for i in first[other]]
                # One least hash over more than w windows: it recurs, so a later place of it is a sample too.
                stop = np.append(first[1:], len(least))
                more = [pos]
                for a, b in zip(first[stop - first > w], stop[stop - first > w]):
                    b = a + int(np.argmin(inside[a:b])) if not inside[a:b].all() else b
                    place = a + np.flatnonzero(h[a : b + w - 1] == least[a])
                    at_window = a
                    while at_window < b:
                        q = int(place[np.searchsorted(place, at_window + w, "left") - 1])
                        more.append(np.array([q]))
                        at_window = q + 1
                pos = np.unique(np.concatenate(more))
                doc = np.searchsorted(off, pos, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(h[pos].view(np.int64)), part.column(0).take(pa.array(doc)), pa.array((pos - off[doc]).astype(np.int32))], ["h", "doc", "pos"])

    return docs.mapInArrow(run, f"h bigint, doc {docs.schema['id'].dataType.simpleString()}, pos int")


def _shared_samples(samples: DataFrame) -> DataFrame:
    groups = samples.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b").select("h")
    return samples.join(groups, "h", "left_semi")


def _doc_filter(samples: DataFrame):
    """A broadcast bitmap of FILTER_BITS bits over the hashed ids of `samples`."""
    word = F.pmod(F.xxhash64("doc"), F.lit(FILTER_BITS))
    words = samples.select(F.shiftright(word, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc), {FILTER_BITS}) % 64 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.collect():  # at most FILTER_BITS / 64 rows
        bits[r["w"]] = r["m"]
    return samples.sparkSession.sparkContext.broadcast(bits)


def _pieces(docs: DataFrame, shared: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, doc, start, piece): the text around every shared sample that can hold a shared stretch."""
    bits = _doc_filter(shared)
    places = shared.groupBy("doc").agg(F.collect_list(F.struct("h", "pos")).alias("at"))

    @F.pandas_udf("boolean")
    def kept(w: pd.Series) -> pd.Series:
        x = w.to_numpy()
        return pd.Series((bits.value[x >> 6] >> (x & 63)) & 1 == 1)

    few = docs.where(kept(F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))))
    joined = few.join(places, few["id"] == places["doc"]).select("doc", "text", F.explode("at").alias("s"))
    before = F.greatest(F.col("s.pos") - (length - gram), F.lit(0))
    return joined.select(F.col("s.h").alias("h"), "doc", before.alias("start"), F.substring("text", before + 1, F.col("s.pos") + length - before).alias("piece"))


def _search(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Matches between the pieces of a partition, one FM-index per bounded part of it."""
    names = ["h_a", "rep_a", "at_a", "h_b", "rep_b", "at_b", "n"]

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        cp, off = vec.decode(*vec.utf8(t.column("piece")))
        alphabet, s = np.unique(cp, return_inverse=True)
        s = s.astype(np.int64) + 1
        ends = np.zeros(len(cp) + t.num_rows, np.int64)
        starts = off[:-1] + np.arange(t.num_rows)
        ends[np.arange(len(cp)) + np.repeat(np.arange(t.num_rows), np.diff(off))] = s
        index = FMIndex(ends, starts, len(alphabet) + 1, length)
        a, x, p = index.matches(s, off)
        b = index.owner(p)
        y = p - starts[b]
        h, rep = t.column("h").to_numpy(), t.column("rep").to_numpy()
        several = t.column("several").to_numpy(zero_copy_only=False)
        itself = (a == b) & (x == y) & several[a]
        ok = (h[a] < h[b]) | ((h[a] == h[b]) & (rep[a] != rep[b]) & (a < b)) | itself
        a, x, b, y = a[ok], x[ok], b[ok], y[ok]
        x, y, n = extend(s, off, a, x, b, y, length)
        ints = lambda v: pa.array(v.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(h[a]), pa.array(rep[a]), ints(x), pa.array(h[b]), pa.array(rep[b]), ints(y), ints(n)], names)

    held, chars, last = [], 0, None
    for batch in batches:
        key = list(zip(batch.column("h").to_pylist(), batch.column("block").to_pylist()))
        size = np.diff(vec.utf8(batch.column("piece"))[1])
        at = 0
        for i in range(batch.num_rows):
            if key[i] != last:
                if chars > SHARD_CHARS:
                    held.append(batch.slice(at, i - at))
                    yield flush([b for b in held if b.num_rows])
                    held, chars, at = [], 0, i
                last = key[i]
            chars += int(size[i])
        held.append(batch.slice(at))
    if chars:
        yield flush([b for b in held if b.num_rows])


def _copies(docs: DataFrame) -> DataFrame:
    """(doc, first): every id with the least id that has the same text (by two 64-bit hashes and the length)."""
    keys = docs.select(F.col("id").alias("doc"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2"), F.length("text").alias("n"))
    first = keys.groupBy("k1", "k2", "n").agg(F.min("doc").alias("first"))
    return keys.join(first, ["k1", "k2", "n"]).select("doc", "first")


def shared_spans(df: DataFrame, id_col: str, text_col: str, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spans of at least `length` characters, exactly as stored, that two different rows share.

    Gives (copies, members, spans). copies: (doc, first), rows of the same text under their least id;
    only that one goes on, so that a text that many rows copy is searched once. members: (h, rep, doc,
    start, size), the pieces of every text around the samples that another text has too; all with the
    same (h, rep) have the same piece. spans: (h_a,
    rep_a, at_a, h_b, rep_b, at_b, n), a span of n characters in two pieces, counted from their
    starts. A pair of rows shares a span if both have one piece of at least `length` characters, or
    two pieces with a span. Null texts and texts under `length` characters share nothing; ids must
    be unique.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") >= length)
    copies = written(_copies(docs))
    again = copies.where("doc <> first").select("doc")
    shared = written(_shared_samples(written(_samples(docs, length, gram).join(again, "doc", "left_anti"))))
    pieces = written(_pieces(docs, shared, length, gram).withColumn("rep", F.xxhash64("piece")))
    distinct = pieces.groupBy("h", "rep").agg(F.min("doc").alias("doc0"), F.max("doc").alias("doc1"), F.any_value("piece").alias("piece")).withColumn("size", F.length("piece"))
    members = pieces.select("h", "rep", "doc", "start", F.length("piece").alias("size"))
    counts = distinct.groupBy("h").agg(F.count("*").alias("m"))
    several = F.col("doc0") != F.col("doc1")
    many = distinct.where(F.length("piece") >= length).select("h", "rep", "piece", several.alias("several")).join(counts, "h").where("m > 1 or several")
    # A sample with more pieces than a block holds meets in every pair of its blocks, a task each.
    blocks = F.ceil(F.col("m") / GROUP_BLOCK)
    own = F.pmod(F.xxhash64("rep"), blocks)
    pair = F.transform(F.sequence(F.lit(0).cast("bigint"), blocks - 1), lambda k: F.least(k, own) * blocks + F.greatest(k, own))
    rows = many.select("h", "rep", "piece", "several", F.explode(pair).alias("block"))
    ordered = rows.repartition("h", "block").sortWithinPartitions("h", "block", "rep")
    spans = ordered.mapInArrow(lambda it: _search(it, length), "h_a bigint, rep_a bigint, at_a int, h_b bigint, rep_b bigint, at_b int, n int")
    return copies, members, written(spans)


def sharing_pairs(copies: DataFrame, members: DataFrame, spans: DataFrame) -> DataFrame:
    """(a, b): every two ids that share a span, a < b, each pair once.

    A class of many members is split: each of its parts on one side meets all members on the other in a task of its own."""
    links = spans.select("h_a", "rep_a", "h_b", "rep_b").distinct()
    m = members.select("h", "rep", "doc").distinct()
    counts = m.groupBy("h", "rep").agg(F.ceil(F.count("*") / MEMBERS).alias("n"))
    left = m.join(counts, ["h", "rep"]).select(F.col("h").alias("h_a"), F.col("rep").alias("rep_a"), F.col("doc").alias("p"), F.pmod(F.xxhash64("doc"), F.col("n")).alias("part"))
    split = links.join(counts.select(F.col("h").alias("h_a"), F.col("rep").alias("rep_a"), "n"), ["h_a", "rep_a"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))).drop("n")
    other = m.select(F.col("h").alias("h_b"), F.col("rep").alias("rep_b"), F.col("doc").alias("q"))
    right = split.join(other, ["h_b", "rep_b"])
    across = left.join(right, ["h_a", "rep_a", "part"]).where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    texts = across.distinct()
    u, v = copies.select(F.col("doc").alias("p"), F.col("first").alias("a")), copies.select(F.col("doc").alias("q"), F.col("first").alias("b"))
    rows = texts.join(u, "a").join(v, "b").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    twice = u.join(v, F.col("a") == F.col("b")).where("p < q").select(F.col("p").alias("a"), F.col("q").alias("b"))
    return rows.unionByName(twice)


def shared_share(df: DataFrame, id_col: str, text_col: str, copies: DataFrame, members: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per row of `df`: (id_col, n_chars, shared_chars, share), the share of its text that also
    stands in another row. A null text has null n_chars and share 0; an empty one has share 0."""
    owners = members.groupBy("h", "rep").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    # A span counts for a row if a piece on its other side belongs to another row.
    side = lambda a, b: spans.select(F.col(f"h_{a}").alias("h"), F.col(f"rep_{a}").alias("rep"), F.col(f"at_{a}").alias("at"), "n", F.col(f"h_{b}").alias("oh"), F.col(f"rep_{b}").alias("orep"))
    others = owners.select(F.col("h").alias("oh"), F.col("rep").alias("orep"), "lo", "hi")
    sides = side("a", "b").unionByName(side("b", "a")).distinct().join(others, ["oh", "orep"]).select("h", "rep", "at", "n", "lo", "hi")
    parts = members.join(sides, ["h", "rep"]).where("lo <> doc or hi <> doc").select("doc", (F.col("start") + F.col("at")).alias("s"), (F.col("start") + F.col("at") + F.col("n")).alias("e"))
    spans_of = parts.distinct().groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("v"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))
    total = F.aggregate("v", zero, lambda a, t: F.struct(F.greatest(a["end"], t["e"]).alias("end"), (a["sum"] + F.greatest(t["e"] - F.greatest(a["end"], t["s"]), F.lit(0))).alias("sum")))["sum"]
    of_text = spans_of.select(F.col("doc").alias("first"), total.alias("shared_chars"))
    several = copies.groupBy("first").agg((F.count("*") > 1).alias("copied"))
    got = copies.join(several, "first").join(of_text, "first", "left").select(F.col("doc").alias("_doc"), "copied", "shared_chars")
    base = df.select(F.col(id_col), F.length(text_col).alias("n_chars"))
    out = base.join(got, base[id_col] == got["_doc"], "left")
    n = F.when(F.col("copied"), F.col("n_chars")).otherwise(F.coalesce("shared_chars", F.lit(0)))
    return out.select(id_col, "n_chars", n.alias("shared_chars"), F.coalesce(F.try_divide(n.cast("double"), F.col("n_chars").cast("double")), F.lit(0.0)).alias("share"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two documents with at least 400 consecutive characters in common."""
    found = shared_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return sharing_pairs(*found).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p9_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document, how much of it also stands in another."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shared_share(docs, "doc_id", "text", *shared_spans(docs, "doc_id", "text"))
