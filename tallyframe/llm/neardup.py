"""Near-duplicate records by the words they have in common, found where several rare ones come together.

A record is the set of its (word, occurrence) elements, so that the share of common words with
repetition is a Jaccard similarity of sets. Elements are ordered by rarity and fall into parts by
hash. Two records above the threshold share so many elements of their prefixes that SHARE of them
are of one part. Records meet in one task under the first of these; where many do, they are told
apart by a second one and so on, so that the comparisons don't grow with the square of the records
where the vocabulary stays the same. Those that meet are compared by size and by a sketch that
bounds their difference; what is left is verified in full. Nothing is left out on the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import vec
from tallyframe.llm.components import components
from tallyframe.llm.shared import drop, written
from tallyframe.llm.vec import U64

THRESHOLD = 0.7
#: Elements of one part that similar records have in common, parts of the elements, and elements that a record shares
#: with its matches per part beyond which there are twice the parts.
SHARE, GROUP, LONG = 4, 4, 32
#: Records of a block; where more than one block has the same elements, blocks meet in pairs.
BLOCK = 10_000
#: Members of a class that one task takes on one side of a pair.
MEMBERS = 2000
#: Blocks beyond which records that meet under an element meet under a further one instead.
SPLIT = 16
#: Records that meet under so few elements as they are, rather than under one more.
FEW = 16
#: Entries of a unit, in which many elements' records meet; elements of a slice; keys that are made at once.
UNIT, SLICE, KEYS = 100_000, 500_000, 2_000_000
#: Counters over hashed elements: a fixed number, however many elements there are.
COUNTERS = 1 << 20
#: Bits by which most rows that a join can't need are kept out of it.
MARKS = 1 << 23


def _elements(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Element hashes of every text, their texts' numbers, and the number of elements per text."""
    cp, off = vec.decode(*vec.utf8(column))
    low = vec._tables["lower"][cp] if len(cp) else cp
    if not len(cp):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(len(column), np.int64)
    b, e = vec.words(low, off)
    h = vec.span_hash(vec.prefix_hash(low), b, e)
    doc = np.searchsorted(off, b, "right") - 1
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
    begin = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    with np.errstate(over="ignore"):
        h = vec.scramble(h + (np.arange(len(h)) - begin).astype(U64) * U64(vec.BASE))
    return h, doc, np.bincount(doc, minlength=len(column))


def _counters(df: DataFrame, run, names: list[str]) -> list[np.ndarray]:
    """Sums over all partitions of counter arrays that `run` makes per partition of `df`."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(COUNTERS, np.int64) for _ in names]
        for batch in batches:
            for t, x in zip(total, run(batch)):
                t += np.bincount((x >> U64(44)).astype(np.int64), minlength=COUNTERS)
        for k, t in enumerate(total):
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(t[at])], ["k", "at", "n"])

    out = [np.zeros(COUNTERS, np.int64) for _ in names]
    sums = df.mapInArrow(emit, "k int, at int, n bigint").groupBy("k", "at").agg(F.sum("n").alias("n"))
    t = sums.toArrow()  # at most COUNTERS rows each
    for k in range(len(names)):
        own = t.filter(pc.equal(t.column("k"), k))
        out[k][own.column("at").to_numpy()] = own.column("n").to_numpy()
    return out


def _need(n: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Elements that a record of n must share with any match, and with one that is no smaller."""
    return np.ceil(threshold * n - 1e-9).astype(np.int64), np.ceil(2 * threshold / (1 + threshold) * n - 1e-9).astype(np.int64)


def _marks(numbers: DataFrame) -> np.ndarray:
    """Bits of a fixed number by hash, set for every number of the table's only column."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_bit(batch.column(0))).astype(np.int32))], ["at"])

    at = numbers.mapInArrow(emit, "at int").distinct().toArrow().column("at").to_numpy()  # at most MARKS rows
    out = np.zeros(MARKS, np.uint8)
    out[at] = 1
    return np.packbits(out)


def _bit(numbers: pa.Array) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (vec.scramble(numbers.to_numpy().view(U64) * U64(vec.BASE)) % U64(MARKS)).astype(np.int64)


def _marked(numbers: pa.Array, marks: np.ndarray) -> np.ndarray:
    at = _bit(numbers)
    return (marks[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)


def _representatives(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, reps): members (id, rep) puts records of the same elements under the least id;
    reps (rep, n, els, k) has each class's elements, the rarest first. Records without words are left out."""
    sc = records.sparkSession.sparkContext
    tables = sc.broadcast(vec.packed_tables("class", "lower"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vec.unpack_tables(tables.value, "class", "lower")
        for batch in batches:
            for part in vec.slices(batch, "text"):
                h, _, n = _elements(part.column("text"))
                ends = np.append(0, np.cumsum(n))
                with np.errstate(over="ignore"):
                    one = np.add.reduceat(np.append(h, U64(0)), np.minimum(ends[:-1], len(h)))
                    two = np.add.reduceat(np.append(vec.scramble(h * U64(vec.BASE)), U64(0)), np.minimum(ends[:-1], len(h)))
                els = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n.astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), els], ["id", "n", "one", "two", "els"])

    kind = records.schema["id"].dataType.simpleString()
    # A number per row stands for its id in the shards.
    sets = written(records.mapInArrow(run, f"id {kind}, n int, one bigint, two bigint, els array<bigint>").withColumn("k", F.monotonically_increasing_id()))
    seen = sc.broadcast(np.minimum(_counters(sets.select("els"), lambda batch: [_flat(batch.column("els"))[0]], ["df"])[0], 2**31 - 1).astype(np.int32))
    # Of a row delivered twice the first one counts.
    firsts = sets.groupBy("id").agg(F.min(F.struct("k", "n", "one", "two")).alias("x")).select("id", "x.*").where("n > 0")
    classes = written(firsts.groupBy("n", "one", "two").agg(F.min(F.struct("id", "k")).alias("x")).select("n", "one", "two", F.col("x.id").alias("rep"), "x.k"))
    members = firsts.select("id", "n", "one", "two").join(classes.drop("k"), ["n", "one", "two"]).select("id", "rep")
    others = written(sets.select("k").join(classes.select("k"), "k", "left_anti"))
    marks = sc.broadcast(_marks(others))

    def ordered(marked: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pa.array(_marked(batch.column("k"), marks.value) == marked))
                h, off = _flat(batch.column("els"))
                h = h[np.lexsort((h, seen.value[_slot(h)], np.repeat(np.arange(batch.num_rows), np.diff(off))))]
                els = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n"), els, batch.column("k")], ["rep", "n", "els", "k"])

        return sets.select(F.col("id").alias("rep"), "n", "els", "k").mapInArrow(run, f"rep {kind}, n int, els array<bigint>, k bigint")

    # Only rows that may be among the others are compared with them.
    reps = written(ordered(False).unionByName(ordered(True).join(others, "k", "left_anti")))
    members = written(members)
    drop(sets, classes, others)
    return members, reps


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[off[0] : off[-1]].view(U64), off - off[0]


def _classes_of_size(parts: int, longest: int, threshold: float) -> list[tuple[int, int, int, int]]:
    """(elements, parts, least, most): how many elements of one of how many parts a record has in common with any match
    that is no smaller, for the records that must share from `least` to `most` elements with such a match."""
    out = [(c, 1, c, c) for c in range(1, SHARE)]
    first = parts * (SHARE - 1) + 1
    if first > SHARE:
        out.append((SHARE, 1, SHARE, first - 1))
    while True:
        most = LONG * parts
        out.append((SHARE, parts, first, most))
        if most >= _need(np.array([longest]), threshold)[1][0]:
            return out
        first, parts = most + 1, parts * 2


def _mixed(key: np.ndarray, h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return vec.scramble(key * U64(vec.BASE) + h)


class _Entries(NamedTuple):
    """Places where a record meets others: `key` stands for the elements taken so far, `more` says how many are still to
    be taken from the `count` elements at `at`; as the smaller of a pair (`small`) from the first `few` of them only."""

    key: np.ndarray
    row: np.ndarray
    at: np.ndarray
    count: np.ndarray
    few: np.ndarray
    small: np.ndarray
    more: np.ndarray

    def take(self, which: np.ndarray) -> _Entries:
        return _Entries(*[x[which] for x in self])


def _joined(many: list[_Entries]) -> _Entries:
    return _Entries(*[np.concatenate(x) for x in zip(*many)])


def _starts(h: np.ndarray, off: np.ndarray, n: np.ndarray, sizes: list[tuple[int, int, int, int]], threshold: float) -> tuple[np.ndarray, _Entries]:
    """Elements of the prefixes part by part, and an entry for each that can be the first one taken of its part."""
    every, least = _need(n, threshold)
    lowest = _need(every, threshold)[1]
    flat, out, base = [], [], 0
    for number, (share, parts, low, high) in enumerate(sizes):
        as_small = (least >= low) & (least <= high)
        as_large = (least >= low) & (lowest <= high)
        if not as_large.any():
            continue
        common = parts * (share - 1) + 1
        few = np.where(as_small, np.minimum(n - least + common, n), 0)
        limit = np.maximum(few, np.where(as_large, np.minimum(n - every + common, n), 0))
        row = np.repeat(np.arange(len(n)), limit)
        index = vec.ragged(off[:-1], limit)
        el = h[index]
        place = row * parts + (el >> U64(20) & U64(0xFFFFFF)).astype(np.int64) % parts
        if parts > 1:
            order = np.argsort(place, kind="stable")
            row, index, el, place = row[order], index[order], el[order], place[order]
        small = index - off[row] < few[row]
        last = np.flatnonzero(np.append(place[1:] != place[:-1], True)) + 1
        end = np.repeat(last, np.diff(np.append(0, last)))
        so_far = np.append(0, np.cumsum(small))
        at = np.arange(1, len(el) + 1)
        count = end - at
        left = np.where(small, so_far[end] - so_far[at], 0)
        ok = count >= share - 1
        key = _mixed(el[ok], np.full(int(ok.sum()), number, U64))
        out.append(_Entries(key, row[ok], at[ok] + base, count[ok], left[ok], small[ok] & (left[ok] >= share - 1), np.full(len(key), share - 1, np.int64)))
        flat.append(el)
        base += len(el)
    if not flat:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), _Entries(none.view(U64), none, none, none, none, none.astype(bool), none)
    return np.concatenate(flat), _joined(out)


def _next(flat: np.ndarray, t: _Entries) -> _Entries:
    """The same meetings by one element more."""
    take = np.maximum(t.count - t.more + 1, 0)
    at = vec.ragged(t.at, take)
    rep = np.repeat(np.arange(len(t.key)), take)
    few, more = t.few[rep] - (at - t.at[rep]).astype(t.few.dtype) - 1, t.more[rep] - 1
    return _Entries(_mixed(t.key[rep], flat[at].astype(U64)), t.row[rep], (at + 1).astype(t.at.dtype), (t.at + t.count)[rep] - at.astype(t.at.dtype) - 1, np.maximum(few, 0), t.small[rep] & (few >= more), more)


def _slot(key: np.ndarray) -> np.ndarray:
    return (key >> U64(44)).astype(np.int64)


def _split(flat: np.ndarray, t: _Entries, counts: list[tuple[np.ndarray, np.ndarray]], most: int) -> tuple[_Entries, np.ndarray, _Entries]:
    """Entries to meet by, how many each meets at most, and those of the level that `counts` doesn't reach.
    Entries that meet none as the smaller of a pair are left out."""
    done, met = [t.take(slice(0, 0))], [np.zeros(0, np.int64)]
    for every, small in counts:
        slot = _slot(t.key)
        ok = small[slot] > 0
        t, slot = t.take(ok), slot[ok]
        hot = (every[slot] > most) & (t.more > 0)
        done.append(t.take(~hot))
        met.append(every[slot[~hot]].astype(np.int64))
        t = _next(flat, t.take(hot))
    return _joined(done), np.concatenate(met), t


def _sketch(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """256 bits per record, the parities of its elements by hash: two records differ in at most as many bits as elements."""
    bit, row = (h >> U64(13) & U64(255)).astype(np.int64), np.repeat(np.arange(len(off) - 1), np.diff(off))
    odd = (np.bincount(row * 256 + bit, minlength=(len(off) - 1) * 256) & 1).astype(np.uint8)
    return np.packbits(odd).view(U64).reshape(-1, 4)


def _blobs(part: pa.RecordBatch, sizes: list[tuple[int, int, int, int]], threshold: float, counts: list[tuple[np.ndarray, np.ndarray]], most: int, block: int, units: int) -> pa.RecordBatch:
    """The entries of a slice of records, packed by the unit that takes them."""
    h, off = _flat(part.column("els"))
    n = part.column("n").to_numpy().astype(np.int64)
    flat, t = _starts(h, off, n, sizes, threshold)
    t, met, _ = _split(flat, t, counts, most)
    blocks = np.where(t.more > 0, 1, np.maximum(1, -(-met // block)))
    own = (vec.scramble(np.add.reduceat(h, off[:-1]))[t.row] % blocks.astype(U64)).astype(np.int64)
    rep = np.repeat(np.arange(len(t.key)), blocks)
    other = vec.ragged(np.zeros(len(blocks), np.int64), blocks)
    t, own, blocks = t.take(rep), own[rep], blocks[rep]
    first, second = np.minimum(own, other), np.maximum(own, other)
    # In a pair of two blocks, 1 and 2 tell them apart.
    side = np.where(first == second, 0, np.where(own == first, 1, 2))
    key = _mixed(t.key, (first * blocks + second).astype(U64))
    unit = (key % U64(units)).astype(np.int64)
    order = np.argsort(unit, kind="stable")
    key, side, t = key[order], side[order], t.take(order)
    count = np.where(t.more > 0, t.count, 0)
    left = (flat[vec.ragged(t.at, count)] >> U64(48)).astype(np.uint16)  # of elements still to be taken, 16 bits are enough
    columns = ((key >> U64(32)).astype(np.uint32), part.column("k").to_numpy()[t.row], n[t.row].astype(np.int32), _sketch(h, off)[t.row], (t.more * 8 + side * 2 + t.small).astype(np.uint8), count.astype(np.int32), np.minimum(t.few, count).astype(np.int32))
    cuts = np.append(np.searchsorted(unit[order], np.arange(units)), len(key))
    ends = np.append(0, np.cumsum(count))
    at = np.flatnonzero(np.diff(cuts))
    blobs = [b"".join([np.int64(b - a).tobytes(), *[x[a:b].tobytes() for x in columns], left[ends[a] : ends[b]].tobytes()]) for a, b in zip(cuts[at], cuts[at + 1])]
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(blobs, pa.binary())], ["unit", "entries"])


def _candidates(reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of records (their numbers) that meet and may be similar by their sizes and sketches.

    Records meet under the first of SHARE elements of a part, and in that task under all of them. Where more than SPLIT
    blocks of records meet under an element, they meet under a second one too, and a third; where more than a block have
    all of them in common, blocks meet in pairs."""
    sc = reps.sparkSession.sparkContext
    rows = reps.select("k", "n", "els")
    longest = rows.agg(F.max("n")).first()[0] or 1
    sizes, most, block = _classes_of_size(GROUP, longest, threshold), SPLIT * BLOCK, BLOCK
    counts: list[tuple[np.ndarray, np.ndarray]] = []
    narrow = lambda x: np.minimum(x, 2**31 - 1).astype(np.int32)
    total = 0
    while len(counts) < SHARE:
        known = sc.broadcast(counts)

        def heads(batch: pa.RecordBatch) -> list[np.ndarray]:
            out = []
            for part in _parts(batch):
                flat, t = _starts(*_flat(part.column("els")), part.column("n").to_numpy().astype(np.int64), sizes, threshold)
                t = _split(flat, t, known.value, most)[2]
                out.append((t.key, t.key[t.small]))
            return [np.concatenate(x) for x in zip(*out)] or [np.zeros(0, U64)] * 2

        every, small = _counters(rows.select("n", "els"), heads, ["every", "small"])
        counts.append((narrow(every), narrow(small)))
        total += int(every[small > 0].sum())
        if not (every[small > 0] > most).any():
            break
    known, units = sc.broadcast(counts), max(1, total // UNIT)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                yield _blobs(part, sizes, threshold, known.value, most, block, units)

    met = rows.mapInArrow(scatter, "unit int, entries binary")
    shards = met.repartition("unit").sortWithinPartitions("unit")
    return shards.mapInArrow(lambda it: _shards(it, threshold), "a bigint, b bigint").distinct()


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of records, of at most so many elements or one record each."""
    ends, at = np.cumsum(batch.column("n").to_numpy(), dtype=np.int64), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield batch.slice(at, end - at)
        at = end


_KINDS = ((np.uint32, 1), (np.int64, 1), (np.int32, 1), (U64, 4), (np.uint8, 1), (np.int32, 1), (np.int32, 1))


def _read(blob: bytes) -> list[np.ndarray]:
    m, at, out = int(np.frombuffer(blob, np.int64, 1)[0]), 8, []
    for kind, width in _KINDS:
        x = np.frombuffer(blob, kind, m * width, at)
        out.append(x.reshape(m, width) if width > 1 else x)
        at += x.nbytes
    return [*out, np.frombuffer(blob, np.uint16, offset=at)]


def _shards(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Candidates of each unit, whose rows lie together."""
    held: list[list[np.ndarray]] = []
    last = None
    for batch in batches:
        for unit, blob in zip(batch.column("unit").to_pylist(), batch.column("entries")):
            if unit != last and held:
                yield from _met([np.concatenate(x) for x in zip(*held)], threshold)
                held = []
            last = unit
            held.append(_read(blob.as_py()))
    if held:
        yield from _met([np.concatenate(x) for x in zip(*held)], threshold)


def _met(columns: list[np.ndarray], threshold: float) -> Iterator[pa.RecordBatch]:
    """Candidates of one unit: records with the same elements, one of them as the smaller of a pair."""
    key, rep, n, sketch, flags, count, few, left = columns
    side, n = flags >> 1 & 3, n.astype(np.int64)
    numbers, own = np.unique(rep, return_inverse=True)
    at = np.cumsum(count, dtype=np.int64) - count
    bounds = ((at + count).astype(np.int32), np.where(flags & 1, at + few, -1).astype(np.int32), (flags >> 3).astype(np.int32))
    found, held = [np.zeros(0, np.int64)], 0
    for a, b in _together(left, bounds, 0, key.astype(U64), np.arange(len(key), dtype=np.int32), at.astype(np.int32)):
        differ = np.bitwise_count(sketch.take(a, 0) ^ sketch.take(b, 0)).view(np.uint32)[:, 0] * np.uint32(0x01010101) >> np.uint32(24)
        na, nb = n[a], n[b]
        ok = np.flatnonzero(differ <= (1 - 2 * threshold / (1 + threshold)) * (na + nb) + 1e-6)  # elements in which they may differ
        a, b, na, nb = a[ok], b[ok], na[ok], nb[ok]
        ok = (rep[a] != rep[b]) & (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9) & ((side[a] != side[b]) | (side[a] == 0))
        a, b = own[a[ok]], own[b[ok]]
        found.append(np.unique(np.minimum(a, b) * len(numbers) + np.maximum(a, b)))
        held += len(found[-1])
        if held > KEYS:
            found, held = [np.unique(np.concatenate(found))], 0
    a, b = np.divmod(np.unique(np.concatenate(found)), max(1, len(numbers)))
    yield pa.RecordBatch.from_arrays([pa.array(numbers[a]), pa.array(numbers[b])], ["a", "b"])


def _together(left: np.ndarray, bounds: tuple[np.ndarray, np.ndarray, np.ndarray], depth: int, key: np.ndarray, row: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Entries (their rows) with the same key, one of them small. Where many have it, and elements may be added, by those.

    `bounds` has, per entry, the end of its elements in `left`, the end as the smaller of a pair, and how many elements
    were to be taken; `depth` of them have been, and the next ones begin at `at`."""
    end, few, more = bounds
    need = more[row] - depth
    bits = U64(max(1, int(len(key)).bit_length()))
    # Sorted by key, then the small ones first.
    code = np.sort((vec.scramble(key) >> (bits + U64(1)) << U64(1) | (few[row] < at + need).astype(U64)) << bits | np.arange(len(key), dtype=U64))
    who = (code & ((U64(1) << bits) - U64(1))).astype(np.int32)
    large = (code >> bits & U64(1)).astype(np.int8)
    code >>= bits + U64(1)
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(code)))
    small = size - np.add.reduceat(large, first, dtype=np.int64) if len(first) else size
    deep = (size > 1) & (small > FEW) & (need[who[first]] > 0)
    pairs = (size > 1) & (small > 0) & ~deep
    x = vec.ragged(first[pairs], small[pairs])
    k = np.repeat((first + size)[pairs], small[pairs]) - x - 1
    share = np.cumsum(k) // 200_000
    rows = row[who]
    for cut in np.split(np.arange(len(x)), np.flatnonzero(np.diff(share)) + 1) if len(x) else []:
        yield rows[np.repeat(x[cut], k[cut])], rows[vec.ragged(x[cut] + 1, k[cut])]
    first, size = first[deep], size[deep]
    if not len(first):
        return
    index = who[vec.ragged(first, size)]
    take = end[row[index]] - at[index] - need[index] + 1
    ends = np.cumsum(size)
    work = np.cumsum(np.add.reduceat(take, ends - size, dtype=np.int64))
    for cut in np.split(np.arange(len(first)), np.flatnonzero(np.diff(work // KEYS)) + 1):
        here = slice(ends[cut[0]] - size[cut[0]], ends[cut[-1]])
        k = take[here]
        place = vec.ragged(at[index[here]], k)
        yield from _together(left, bounds, depth + 1, _mixed(np.repeat(key[index[here]], k), left[place].astype(U64)), np.repeat(row[index[here]], k), (place + 1).astype(np.int32))


def similar_classes(df: DataFrame, id_col: str, text_cols: list[str], threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members, links). members (id, rep): records of the same words under the least id of them.
    links (a, b, similarity): representatives whose similarity is at least `threshold`, a < b.

    The text is the columns together, a null as an empty one; words are runs of letters and digits,
    case ignored. The similarity counts common words with repetition over the words of both without
    counting common ones twice. A row delivered twice is one record. A record without any word is
    similar to none and is in neither table.
    """
    text = F.concat_ws("\n", *[F.col(c).cast("string") for c in text_cols])
    records = df.select(F.col(id_col).alias("id"), text.alias("text")).where("id is not null")
    members, reps = _representatives(records)
    pairs = written(_candidates(reps, threshold))
    marks = reps.sparkSession.sparkContext.broadcast(_marks(pairs.select(F.explode(F.array("a", "b")).alias("k"))))

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_marked(batch.column("k"), marks.value)))

    reps = reps.mapInArrow(paired, reps.schema)
    left = reps.select(F.col("k").alias("a"), F.col("rep").alias("ra"), F.col("n").alias("na"), F.col("els").alias("ea"))
    right = reps.select(F.col("k").alias("b"), F.col("rep").alias("rb"), F.col("n").alias("nb"), F.col("els").alias("eb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("o", F.size(F.array_intersect("ea", "eb")))
    similarity = F.col("o").cast("double") / (F.col("na") + F.col("nb") - F.col("o"))
    close = both.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), similarity.alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)
    return members, written(close.distinct())


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b): every two similar records, the smaller id first, exact copies among them.

    A class of many members is split: each part on one side meets all members on the other in a task of its own."""
    counts = members.groupBy("rep").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    x = members.join(counts, "rep").select(F.col("id").alias("p"), F.col("rep").alias("a"), F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
    itself = members.groupBy("rep").agg(F.count("*").alias("m")).where("m > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(True).alias("same"))
    every = links.select("a", "b", F.lit(False).alias("same")).unionByName(itself)
    split = every.join(counts.withColumnRenamed("rep", "a"), "a").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")
    y = split.join(members.select(F.col("id").alias("q"), F.col("rep").alias("b")), "b")
    met = x.join(y, ["a", "part"]).where("not same or p < q")
    return met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def groups(df: DataFrame, id_col: str, members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per record: (id_col, group_id, links): the least id of its group of records linked
    directly or through others, and the number of records similar to it. A record without words, or
    similar to none, is its own group with 0 links."""
    size = members.groupBy("rep").agg(F.count("*").alias("m"))
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = ends.join(size, ends["b"] == size["rep"]).groupBy("a").agg(F.sum("m").alias("near"))
    label = components(links.select("a", "b"))
    per_rep = size.join(near, size["rep"] == near["a"], "left").select("rep", (F.coalesce("near", F.lit(0)) + F.col("m") - 1).alias("links"))
    per_rep = per_rep.join(label, per_rep["rep"] == label["node"], "left").select("rep", "links", F.coalesce("label", "rep").alias("group_id"))
    known = members.join(per_rep, "rep").select(F.col("id").alias("_id"), "group_id", "links")
    ids = df.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    return ids.join(known, ids[id_col] == known["_id"], "left").select(id_col, F.coalesce("group_id", id_col).alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def _classes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    df = spark.read.parquet(f"{d}/cases.parquet")
    return df, *similar_classes(df, "id", ["prompt", "reference"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two cases whose words of prompt and reference agree to at least 70 %."""
    _, members, links = _classes(spark, sf_dir)
    return all_pairs(members, links).select(F.col("a").alias("case_id_a"), F.col("b").alias("case_id_b"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case with its group of edited copies and its number of links."""
    df, members, links = _classes(spark, sf_dir)
    return groups(df, "id", members, links)
