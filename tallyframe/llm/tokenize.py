"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Per slice of text, all in array passes: character classes and class changes give the words of the
byte-level pattern; equal words are found by hash and encoded once; new words go through merge
rounds on one flat array of symbols, in which every round looks the pairs up by binary search over
the sorted pair keys, takes each word's lowest rank and joins its pairs from left to right.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import vec
from tallyframe.llm.vec import U64

#: Words a worker keeps encoded; when full it starts anew. A longer word than LONG bytes is not kept.
CACHE_WORDS, LONG = 400_000, 48
#: Contractions of the pattern: after a free apostrophe, one or two letters (fixed values).
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a vocabulary file among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def load_vocabulary(path: str) -> dict[str, np.ndarray]:
    """Ids of the single bytes, and the merges as sorted pair keys with their ranks and new ids."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids = model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    left = np.array([ids[a] for a, _ in pairs], np.int64)
    right = np.array([ids[b] for _, b in pairs], np.int64)
    new = np.array([ids[a + b] for a, b in pairs], np.int32)
    key = (left << 20) | right
    order = np.argsort(key)
    return {"bytes": np.array([ids[c] for c in byte_alphabet()], np.int32), "keys": key[order], "ranks": order.astype(np.int32), "new": new[order]}


def word_starts(cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the pattern's words, in characters, over texts at `off`; every text begins anew."""
    n = len(cp)
    k = vec._tables["class"][cp] if "class" in vec._tables else vec.class_table()[cp]
    start = np.ones(n, np.bool_)
    start[1:] = k[1:] != k[:-1]
    first = off[:-1]
    begins = np.zeros(n + 1, np.bool_)
    begins[off] = True
    start[first[first < n]] = True
    # White space before another word: its last character stands alone, or with the word if it is a blank.
    last = np.flatnonzero((k[:-1] == vec.SPACE) & (k[1:] != vec.SPACE) & ~begins[1:n])
    start[last] = True
    start[last[cp[last] == 32] + 1] = False
    # Contractions: an apostrophe that begins a word and is a run of its own.
    a = np.flatnonzero(cp == 39)
    a = a[start[a]]
    a = a[a + 1 < n]
    a = a[~begins[a + 1]]
    if len(a):
        padded = np.concatenate([cp, np.zeros(2, cp.dtype)])
        x, y = padded[a + 1], padded[a + 2]
        two = np.zeros(len(a), np.bool_)
        for p, q in TWO_LETTERS:
            two |= (x == ord(p)) & (y == ord(q))
        two &= ~begins[np.minimum(a + 2, n)]
        one = np.isin(x, [ord(c) for c in ONE_LETTER])
        start[a[one | two] + 1] = False
        for at, width in ((a[one], 2), (a[two & ~one], 3)):
            at = at + width
            start[at[at < n]] = True
    return np.flatnonzero(start)


def merge_rounds(symbols: np.ndarray, word: np.ndarray, vocab: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Joins pairs of adjoining symbols of one word, lowest rank first, until no pair is known."""
    keys, ranks, new = vocab["keys"], vocab["ranks"], vocab["new"]
    none = np.int32(2**31 - 1)
    done_symbols, done_words = [], []
    while len(symbols):
        key = (symbols[:-1].astype(np.int64) << 20) | symbols[1:]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        known = (keys[at] == key) & (word[1:] == word[:-1])
        rank = np.append(np.where(known, ranks[at], none), none)
        bound = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        low = np.minimum.reduceat(rank, bound)
        size = np.diff(np.append(bound, len(word)))
        live = np.repeat(low != none, size)
        if not live.all():
            done_symbols.append(symbols[~live])
            done_words.append(word[~live])
            symbols, word, rank, low, size = symbols[live], word[live], rank[live], low[low != none], size[low != none]
            at = np.append(at, 0)[live]
            if not len(symbols):
                break
        else:
            at = np.append(at, 0)
        hit = rank == np.repeat(low, size)
        p = np.flatnonzero(hit)
        # Of overlapping pairs, as in a run of one symbol, every other one from the left is joined.
        run = np.append(True, np.diff(p) > 1)
        begin = np.maximum.accumulate(np.where(run, np.arange(len(p)), 0))
        p = p[(np.arange(len(p)) - begin) % 2 == 0]
        symbols = symbols.copy()
        symbols[p] = new[at[p]]
        keep = np.ones(len(symbols), np.bool_)
        keep[p + 1] = False
        symbols, word = symbols[keep], word[keep]
    if not done_symbols:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
    order = np.argsort(word, kind="stable")
    return symbols[order], word[order]


class Encoder:
    """Encodes slices of texts; keeps the words it has met, up to CACHE_WORDS."""

    def __init__(self, vocab: dict[str, np.ndarray]):
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, U64)
        self.row = np.zeros(0, np.int64)
        self.offsets = np.zeros(1, np.int64)
        self.values = np.zeros(0, np.int32)

    def _new_words(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of words given by their bytes: values and counts."""
        symbols = self.vocab["bytes"][raw[vec.ragged(begin, size)]]
        values, word = merge_rounds(symbols, np.repeat(np.arange(len(begin)), size), self.vocab)
        return values, np.bincount(word, minlength=len(begin))

    def encode(self, column: pa.Array) -> pa.ListArray:
        data, byte_off = vec.utf8(column)
        if not data:
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(column) + 1, np.int32)), pa.array(np.zeros(0, np.int32)))
        raw = np.frombuffer(data, np.uint8)
        cp, off = vec.decode(data, byte_off)
        begin = word_starts(cp, off)
        first_word = np.searchsorted(begin, off)
        if len(cp) == len(raw):
            start = begin
        else:
            start = np.flatnonzero((raw & 0xC0) != 0x80)[begin]
        size = np.diff(np.append(start, len(raw)))
        h = vec.span_hash(vec.prefix_hash(raw), start, start + size)
        long = np.flatnonzero(size > LONG)
        if len(long):  # never taken for equal by hash alone
            h[long] = vec.scramble(np.arange(len(long), dtype=U64) + U64(1 << 40))
        distinct, where, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        have = self.hashes[at] == distinct if len(self.hashes) else np.zeros(len(distinct), np.bool_)
        have &= size[where] <= LONG
        fresh = np.flatnonzero(~have)
        values, counts = self._new_words(raw, start[where[fresh]], size[where[fresh]])
        base = len(self.values)
        pool = np.concatenate([self.values, values])
        word_at, word_n = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        if have.any():
            r = self.row[at[have]]
            word_at[have], word_n[have] = self.offsets[r], self.offsets[r + 1] - self.offsets[r]
        word_at[fresh], word_n[fresh] = base + np.cumsum(counts) - counts, counts
        n = word_n[back]
        out = pool[vec.ragged(word_at[back], n)]
        ends = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=ends[1:])
        result = pa.ListArray.from_arrays(pa.array(ends[first_word].astype(np.int32)), pa.array(out))
        keep = fresh[size[where[fresh]] <= LONG]
        if len(keep):
            if len(self.hashes) + len(keep) > CACHE_WORDS:
                self.clear()
            kept = np.isin(fresh, keep)
            self.row = np.concatenate([self.row, len(self.offsets) - 1 + np.arange(len(keep))])
            self.values = np.concatenate([self.values, values[np.repeat(kept, counts)]])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(counts[kept])])
            self.hashes = np.concatenate([self.hashes, distinct[keep]])
            order = np.argsort(self.hashes, kind="stable")
            self.hashes, self.row = self.hashes[order], self.row[order]
        return result


_encoders: dict[str, Encoder] = {}


def encode_texts(df: DataFrame, id_col: str, text_col: str, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """Token ids of every row's text: (id_col, ids_col array<int>), one row per row of `df`.

    A null or an empty text gives an empty list. Strings that look like special tokens are plain
    text; no special token is added. Other columns are not read. The vocabulary (a fixed file,
    under 2 MB) is broadcast as arrays; nothing is shuffled.
    """
    spark = df.sparkSession
    path = path or vocabulary_path()
    vocab = spark.sparkContext.broadcast(load_vocabulary(path))
    tables = spark.sparkContext.broadcast(vec.packed_tables("class"))
    source = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vec.unpack_tables(tables.value, "class")
        encoder = _encoders.setdefault(path, Encoder(vocab.value))
        for batch in batches:
            for part in vec.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), encoder.encode(part.column("text"))], [id_col, ids_col])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, `{ids_col}` array<int>")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k."""
    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
