"""Values cut off by a field limit or in transfer, told from their last characters.

A backward character n-gram model holds, for the contexts in which values end, how often the context
is followed by the end of a line or value and how often by more text, over all values. Contexts are
read backwards from the end, from two characters to twelve, and each longer one refines the estimate
of the shorter. A value whose log odds of ending stay below the threshold of its language and column
was cut; so was one that leaves a quotation, bracket or code fence open. Texts inside JSON values
are judged as the value's own.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm import vec
from tallyframe.llm.langid import language
from tallyframe.llm.shared import written
from tallyframe.llm.vec import U64

ORDERS = (2, 3, 5, 8, 12)
#: Bits a key and most bits (as a power of two) of the filter in front of the counting. It only saves work: it
#: lets every key through that is counted, and what else it lets through is never looked up.
FILTER_BITS, FILTER_MOST = 16, 25
#: Unsummed keys that a task holds at most.
HELD = 1 << 21
#: Weight of the shorter context's estimate in that of the longer, and the least count of a context.
BACKOFF, SUPPORT = 30.0, 8
#: Log odds between which a threshold is sought, where it is sought first, and the weight, in values, that all
#: languages of a column have in the distribution of one.
LOW, HIGH, DEFAULT, POOLED = -7.0, -3.0, -4.0, 200.0
#: A length is a limit if at least so many values of a column, or of a column and source, have it, so many times as many
#: as its neighbours within REACH on average; for values of that length the threshold is higher by SHIFT.
SPIKE, TIMES, REACH, SHIFT = 20, 4.0, 12, 2.5
PROSE, LIST, SHORT = 0, 1, 2
_ITEM = re.compile(r"\s*(?:[-*•|]|\d+[.)])\s")
_BARE_ITEM = re.compile(r"\n\s*(?:[-*•]|\d+[.)]?)\s*$")
#: A phrase under so many characters, of so many words at most and without an end is complete by itself: a label,
#: a number, a short answer.
SHORT_CHARS, SHORT_WORDS = 40, 5
_CUT_MARKS = ("…", "�")


def open_structure(text: str) -> bool:
    """Whether a JSON-like or fenced text ends before what it opened is closed."""
    t = text.strip()
    if t.count("```") % 2:
        return True
    if t[:1] not in ("{", "["):
        return False
    stack, quote, escaped = [], "", False
    for c in t:
        if quote:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == quote:
                quote = ""
        elif c == '"' or c == "'" and "'" in t[1:4]:
            quote = c
        elif c in "{[":
            stack.append(c)
        elif c in "}]" and stack:
            stack.pop()
    return bool(quote or stack)


def parse_loosely(text: str):
    """A JSON value, or one in Python's notation, or with a comma too many; None if it is none of them."""
    t = text.strip()
    if t[:1] not in ("{", "["):
        return None
    for attempt in (lambda: json.loads(t), lambda: json.loads(re.sub(r",\s*([}\]])", r"\1", t)), lambda: ast.literal_eval(t)):
        try:
            return attempt()
        except (ValueError, SyntaxError, RecursionError, MemoryError):
            continue
    return None


def _inner(value) -> Iterator[str]:
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, str):
            if v.strip() and _mode(v.strip()) != SHORT:
                yield v
        elif isinstance(v, dict):
            todo += list(v.values())
        elif isinstance(v, (list, tuple)):
            todo += list(v)


def units(text: str | None) -> tuple[list[str], bool]:
    """The texts of a value that are to end properly, and whether its structure was left open."""
    if not text or not text.strip():
        return [], False
    t = text.rstrip()
    if t[-1] in _CUT_MARKS:
        return [], True
    if t.lstrip()[0] in "{[":
        value = parse_loosely(t)
        if value is not None:
            return list(_inner(value)), False
        if open_structure(t):
            return [], True
        t = t[max(t.rfind("}"), t.rfind("]")) + 1 :].strip()  # text behind the structure
    if "```" in t:
        if t.count("```") % 2:
            return [], True
        t = t[t.rfind("```") + 3 :].strip()
    if _BARE_ITEM.search(t):
        return [], True
    if not t or t == text.strip() and "\n" not in t and _mode(t) == SHORT:
        return [], False
    return [t], False


def _mode(line: str) -> int:
    if _ITEM.match(line):
        return LIST
    return SHORT if len(line) < SHORT_CHARS and line[-1:] not in ".!?。" and len(line.split()) <= SHORT_WORDS else PROSE


class Batch:
    """The units of a batch as code points with digits as one, and a mode for every line."""

    def __init__(self, texts: list[str]):
        lines, mode, self.last = [], [], []
        for t in texts:
            parts = [x for x in t.split("\n") if x.strip()]
            modes = [_mode(x) for x in parts]
            if len(parts) > 1 and modes[-1] == SHORT != modes[-2]:
                modes[-1] = PROSE  # a few words behind whole lines are no line of their own kind
            lines += parts
            mode += modes
            self.last.append(len(lines) - 1)
        self.mode = np.array(mode, np.int64)
        cp, off = vec.decode(*vec.utf8(pa.array(["\x02\x02" + x.rstrip() for x in lines], pa.string())))
        cp = np.where((cp >= 48) & (cp <= 57), 48, cp)
        # One digit stands for a run of them.
        keep = np.append(True, (cp[1:] != 48) | (cp[:-1] != 48)) if len(cp) else np.zeros(0, np.bool_)
        at = np.append(0, np.cumsum(keep))
        self.cp, self.off = cp[keep], at[off]
        self.line = np.repeat(np.arange(len(lines)), np.diff(self.off))

    def keys(self, k: int, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64-bit keys of the contexts of k characters that stop before `end`, and which ends have one."""
        line = self.line[end - 1]
        ok = end - k >= self.off[line]
        end, line = end[ok], line[ok]
        p = self.prefix()
        with np.errstate(over="ignore"):
            h = (p[end] - p[end - k]) * vec.powers(len(p))[1][end - k]
            return vec.scramble(h + (self.mode[line] + 3 * k).astype(U64) * U64(vec.BASE)), ok

    def all_keys(self, k: int) -> np.ndarray:
        """The keys of the contexts of k characters that stop anywhere: those of `keys`, by whole stretches."""
        p = self.prefix()
        if len(p) <= k:
            return np.zeros(0, U64)
        if not hasattr(self, "_depth"):
            self._depth = np.arange(1, len(self.cp) + 1) - self.off[self.line]
            with np.errstate(over="ignore"):
                self._mode = (self.mode.astype(U64) * U64(vec.BASE))[self.line]
        ok = self._depth[k - 1 :] >= k
        with np.errstate(over="ignore"):
            h = p[k:] - p[:-k]
            h *= vec.powers(len(p))[1][: len(h)]
            h += self._mode[k - 1 :]
            h += U64(3 * k) * U64(vec.BASE)
        return vec.scramble(h[ok])

    def prefix(self) -> np.ndarray:
        if not hasattr(self, "_p"):
            self._p = vec.prefix_hash(self.cp)
        return self._p


def _texts(batch: pa.RecordBatch) -> Iterator[list[str]]:
    for part in vec.slices(batch, "text"):
        out: list[str] = []
        for t in part.column("text").to_pylist():
            out += units(t)[0]
        if out:
            yield out


def read_values(values: DataFrame) -> DataFrame:
    """(table_name, record_id, field_name, source, chars, lang, open, ends) of every value with a text: open
    whether its structure is, ends the keys of the contexts in which its texts end, from the shortest on."""

    names = ["table_name", "record_id", "field_name", "source", "chars", "lang", "open", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vec.slices(batch, "text"):
                count, texts, langs, opened = [], [], [], []
                for t in part.column("text").to_pylist():
                    u, cut = units(t)
                    opened.append(cut)
                    langs.append(language(t))
                    count.append(len(u))
                    texts += u
                keys, has = np.zeros((len(texts), len(ORDERS)), np.int64), np.zeros((len(texts), len(ORDERS)), np.bool_)
                if texts:
                    b = Batch(texts)
                    for i, k in enumerate(ORDERS):
                        h, has[:, i] = b.keys(k, b.off[1:][b.last])
                        keys[has[:, i], i] = h.view(np.int64)
                each = pa.ListArray.from_arrays(np.append(0, np.cumsum(has.sum(axis=1))).astype(np.int32), pa.array(keys[has]))
                ends = pa.ListArray.from_arrays(np.append(0, np.cumsum(count)).astype(np.int32), each)
                keep = [part.column(c) for c in names[:5]]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(langs, pa.string()), pa.array(opened, pa.bool_()), ends], names)

    rows = values.select("table_name", "record_id", "field_name", "source", F.length("text").alias("chars"), "text")
    return rows.mapInArrow(run, "table_name string, record_id string, field_name string, source string, chars int, lang string, open boolean, ends array<array<bigint>>")


def _filter(keys: DataFrame) -> np.ndarray:
    """The filter of the keys, packed: two bits of each are set. At most 2 ** FILTER_MOST / 64 rows are gathered."""
    bits = min(FILTER_MOST, max(16, (FILTER_BITS * keys.count()).bit_length()))
    bit = F.explode(F.array(F.shiftrightunsigned("key", 64 - bits), F.col("key").bitwiseAND(F.lit((1 << bits) - 1))))
    word = keys.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("v"))
    t = word.toArrow()
    out = np.zeros((1 << bits) // 64, np.int64)
    out[t.column("w").to_numpy()] = t.column("v").to_numpy()
    return out.view(np.uint8)


def count_contexts(values: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, n, e): how often a context of `keys` (key; each once) occurs in the values (text), and how often at
    the end of a line or value. Counts are by whole key, summed per task before the shuffle; rows of other keys
    may be among them."""
    passed = values.sparkSession.sparkContext.broadcast(_filter(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = np.unpackbits(passed.value, bitorder="little").view(np.bool_)
        top, low = U64(65 - len(has).bit_length()), U64(len(has) - 1)
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]  # anywhere, at an end

        def add(to: list, h: np.ndarray) -> None:
            h = h[has[h >> top]]
            h = h[has[h & low]]
            to.append(np.unique(h, return_counts=True))

        def sums() -> Iterator[pa.RecordBatch]:
            for i, to in enumerate(held):
                if to:
                    k, at = np.unique(np.concatenate([x for x, _ in to]), return_inverse=True)
                    c = np.bincount(at, np.concatenate([n for _, n in to]), len(k)).astype(np.int64)
                    zero = np.zeros(len(k), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(zero if i else c), pa.array(c if i else zero)], ["key", "n", "e"])
                to.clear()

        for batch in batches:
            for texts in _texts(batch):
                b = Batch(texts)
                for k in ORDERS:
                    add(held[0], b.all_keys(k))
                    add(held[1], b.keys(k, b.off[1:])[0])
                if sum(len(x) for to in held for x, _ in to) > HELD:
                    yield from sums()
        yield from sums()

    return values.select("text").mapInArrow(run, "key bigint, n bigint, e bigint").groupBy("key").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))


def log_odds(ends: DataFrame, counts: DataFrame) -> DataFrame:
    """(end, odds): log odds that a text ends with these contexts, its own end left out of the counts.

    ends: (end, keys), each once; the end is named by the key of its longest context.
    """
    of = ends.select("end", F.posexplode("keys").alias("at", "key")).join(counts, "key")
    per = of.groupBy("end").agg(F.array_sort(F.collect_list(F.struct("at", "n", "e"))).alias("v"))  # a row per order

    def refine(a, x):
        n = x["n"] - 1
        live = a["live"] & (n >= SUPPORT)
        return F.struct(F.when(live, (x["e"] - 1 + BACKOFF * a["p"]) / (n + BACKOFF)).otherwise(a["p"]).alias("p"), live.alias("live"))

    p = F.aggregate("v", F.struct(F.lit(0.02).alias("p"), F.lit(True).alias("live")), refine, lambda a: F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), a["p"])))
    return per.select("end", p.alias("p")).select("end", F.log(F.col("p") / (1 - F.col("p"))).alias("odds"))


def score_values(values: DataFrame) -> DataFrame:
    """(table_name, record_id, field_name, source, chars, lang, odds, open) of every value with a text:
    odds is the least log odds of its texts (null without any), open whether its structure is.

    The model is of all rows of `values`; only contexts in which some value ends are counted. Two passes over the values.
    """
    read = written(read_values(values).withColumn("row", F.monotonically_increasing_id()))
    longest = lambda x: F.element_at(x, -1)
    ends = written(read.select(F.explode("ends").alias("keys")).groupBy(longest("keys").alias("end")).agg(F.any_value("keys").alias("keys")))
    keys = written(ends.select(F.explode("keys").alias("key")).distinct())
    odds = written(log_odds(ends, count_contexts(values, keys)))
    names = ["table_name", "record_id", "field_name", "source", "chars", "lang", "open"]
    rows = read.select("row", *names, F.explode_outer(F.array_distinct(F.transform("ends", longest))).alias("end"))
    least = rows.join(odds, "end", "left").groupBy("row").agg(*[F.first(c).alias(c) for c in names], F.min("odds").alias("odds"))
    return written(least.select(*names[:6], "odds", "open"))


def thresholds(scored: DataFrame) -> DataFrame:
    """(lang, field_name, threshold): the middle of the emptiest stretch of log odds between LOW and HIGH, the one
    next to DEFAULT among several. The distribution is the language's own in the column, with that of the
    whole column as POOLED values besides, so that few values have no threshold of their own."""
    step = 0.25
    bins = int((HIGH - LOW) / step)
    at = F.floor((F.col("odds") - LOW) / step).cast("int")
    counts = scored.where("odds is not null").groupBy("lang", "field_name", F.greatest(F.lit(-1), F.least(F.lit(bins), at)).alias("bin")).agg(F.count("*").alias("n"))
    entries = lambda n: F.map_from_entries(F.collect_list(F.struct("bin", n)))  # noqa: E731 - at most bins + 2
    field = counts.groupBy("field_name", "bin").agg(F.sum("n").alias("n"))
    field = field.groupBy("field_name").agg(F.sum("n").alias("of"), entries("n").alias("g"))
    per = counts.groupBy("lang", "field_name").agg(entries("n").alias("h")).join(field, "field_name")
    width = 3
    held = lambda m, b: F.aggregate(F.sequence(b - (width - 1) // 2, b + width // 2), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(F.try_element_at(m, x), F.lit(0)))
    near = lambda b: held("h", b) + POOLED * held("g", b) / F.col("of")
    middle = F.lit(int((DEFAULT - LOW) / step))
    best = F.array_min(F.transform(F.sequence(F.lit(1), F.lit(bins - 2)), lambda b: F.struct(near(b).alias("n"), F.abs(b - middle).alias("d"), b.alias("b"))))["b"]
    return per.select("lang", "field_name", (F.lit(LOW) + (best + 0.5) * step).alias("threshold"))


def length_limits(values: DataFrame, by: list[str]) -> DataFrame:
    """(*by, chars): lengths at which the values (*by, chars) of a group pile up."""
    per = values.where("chars > 0").groupBy(*by, "chars").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy("chars").rangeBetween(-REACH, REACH)  # a row per length
    around = (F.sum("n").over(w) - F.col("n")) / (2 * REACH)
    return per.select(*by, "chars", "n", around.alias("around")).where((F.col("n") >= SPIKE) & (F.col("n") >= TIMES * F.col("around"))).select(*by, "chars")


def find_cut(values: DataFrame) -> DataFrame:
    """The rows of `score_values` with cut: whether the value was cut off.

    values: (table_name, record_id, field_name, source, text). A null, empty or white text is not
    cut. A row delivered twice is to be dropped before.
    """
    scored = score_values(values)
    limit = thresholds(scored).select(F.col("lang").alias("_lang"), F.col("field_name").alias("_field"), "threshold")
    joined = scored.join(F.broadcast(limit), F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("field_name") == F.col("_field")), "left")  # languages x columns
    limits = length_limits(scored, ["field_name"]).withColumn("limited", F.lit(True))
    joined = joined.join(limits, ["field_name", "chars"], "left")
    own = length_limits(scored.where("source is not null"), ["field_name", "source"]).withColumn("limited_here", F.lit(True))
    joined = joined.join(own, ["field_name", "source", "chars"], "left")
    bar = F.coalesce("threshold", F.lit(DEFAULT)) + F.when(F.col("limited") | F.col("limited_here"), SHIFT).otherwise(0.0)
    cut = F.col("open") | F.coalesce(F.col("odds") < bar, F.lit(False))
    return joined.select("table_name", "record_id", "field_name", "source", "chars", "lang", "odds", "open", cut.alias("cut"))


def _values(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/evaluations.parquet").select("id", "metadata_json", F.col("model_output").alias("text")).dropDuplicates(["id"])
    e = e.select(F.lit("evaluations").alias("table_name"), F.col("id").alias("record_id"), F.lit("model_output").alias("field_name"), F.get_json_object("metadata_json", "$.target").alias("source"), "text")
    r = spark.read.parquet(f"{d}/case_results.parquet").select("id", "run_id", "output", "target_meta").dropDuplicates(["id"])
    runs = spark.read.parquet(f"{d}/runs.parquet").select(F.col("id").alias("run"), "target_name")
    r = r.join(runs, r["run_id"] == runs["run"], "left")
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("t")) for c in ("output", "target_meta")]))
    r = r.select("id", "target_name", fields.alias("x")).select(F.lit("case_results").alias("table_name"), F.col("id").alias("record_id"), F.col("x.f").alias("field_name"), F.col("target_name").alias("source"), F.col("x.t").alias("text"))
    return written(e.unionByName(r).where("text is not null"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value that was cut off."""
    return find_cut(_values(spark, sf_dir)).where("cut").select("table_name", "record_id", "field_name")


def p3_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values, cut values and their share, per source and column; a value without a known source has a null one."""
    found = find_cut(_values(spark, sf_dir))
    per = found.groupBy("source", "table_name", "field_name").agg(F.count("*").alias("n_values"), F.count_if("cut").alias("n_cut"))
    return per.withColumn("share", F.round(F.col("n_cut") / F.col("n_values"), 9))
