"""Benchmark decontamination with suffix arrays of the training text.

The texts of a partition are cut into shards of about ``_SHARD_BYTES``.  Each shard's suffix array
is the order of all its word positions by the words that follow (as many as a window has, up to
the end of the text).  Every window-long suffix of every benchmark item is found in it by
binary search, some words at a time; the range of equal suffixes gives all verbatim
occurrences and their places.  The first of them on each diagonal is extended word by word to
the longest verbatim match.

The benchmark is the only thing broadcast: as numbers of words, in blocks of at most ``block_bytes``
of text (about three times as much in memory).  With several blocks the rows are written
between the passes and each block is released before the next.

Nulls and empty texts have no words; a null item has no windows; items with the
same id count once; an item whose id is null counts under the empty id.  Repeated
rows of documents are answered one by one.  Very long texts are a shard of their own.  Empty tables:
no documents give an empty result, no items leave every document clean.  Extra columns are ignored by
:func:`contamination` and kept, whatever their names, by :func:`remove_contaminated`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilquery.llm._common import ALNUM_LOWER, durable, release, text_slices, unused, words_of

_SHARD_BYTES = 2 << 20

_FOUND = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("item", T.StringType()),
    ]
)


class _Block:
    """Windows of some benchmark items: word numbers (1.. in order of the hashes; 0 is any other word), packed for search."""

    def __init__(self, rows: list[tuple[str, str]], window: int):
        words = [words_of(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), ALNUM_LOWER).hashes for _, t in rows]
        self.items = [i for i, _ in rows]
        self.window = window
        self.vocabulary = np.unique(np.concatenate(words)) if words else np.empty(0, np.uint64)
        self.per_key = 3 if len(self.vocabulary) < (1 << 20) - 1 else 2
        self.bits = 62 // self.per_key
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(lengths)])
        self.numbers = np.zeros(first[-1] + window, dtype=np.int32)
        if first[-1]:
            self.numbers[: first[-1]] = np.searchsorted(self.vocabulary, np.concatenate(words)) + 1
        self.end = np.repeat(first[1:], lengths)
        self.item = np.repeat(np.arange(len(words)), lengths)
        self.first = first[self.item]
        size = np.minimum(lengths, window)[self.item]
        at = np.arange(first[-1])
        starts = np.flatnonzero(at + size <= self.end)
        #: by length in words: where the windows begin
        self.windows = {int(m): starts[size[starts] == m] for m in np.unique(size[starts])}

    def keys(self, numbers: np.ndarray, at: np.ndarray, end: np.ndarray, words: int, beyond: int = 0) -> list[np.ndarray]:
        """The next ``words`` word numbers of each position, packed; beyond the end stands ``beyond``."""
        out = []
        for a in range(0, words, self.per_key):
            key = np.zeros(len(at), dtype=np.int64)
            for k in range(a, a + self.per_key):
                inside = (at + k < end) if k < words else np.zeros(len(at), dtype=bool)
                key = key << self.bits | np.where(inside, numbers[np.minimum(at + k, len(numbers) - 1)], beyond)
            out.append(key)
        return out

    def found(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words, lengths and items of all longest verbatim matches in these texts."""
        none = np.empty(0, dtype=np.int64)
        h = words.hashes
        if not len(self.vocabulary) or not len(h):
            return none, none, none
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        numbers = np.where(self.vocabulary[at] == h, at + 1, 0)
        end = np.repeat(words.first[1:], np.diff(words.first))
        begin = np.repeat(words.first[:-1], np.diff(words.first))
        suffixes = self.keys(numbers, np.arange(len(h)), end, self.window)
        order = np.lexsort(suffixes[::-1])
        suffixes = [k[order] for k in suffixes]
        places, lengths, items = [], [], []
        for m, starts in self.windows.items():
            stop = starts + m
            low = self.keys(self.numbers, starts, stop, m)
            high = self.keys(self.numbers, starts, stop, m, (1 << self.bits) - 1)
            alive = np.arange(len(starts))
            lo, hi = np.zeros(len(starts), dtype=np.int64), np.full(len(starts), len(h))
            for key, a, b in zip(suffixes, low, high, strict=False):
                lo, hi = _bisect(key, a[alive], lo, hi, False), _bisect(key, b[alive], lo, hi, True)
                some = hi > lo
                alive, lo, hi = alive[some], lo[some], hi[some]
            count = hi - lo
            place = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
            j = np.repeat(starts[alive], count)
            # a match whose words before are equal too is part of a longer one
            inner = (place > begin[place]) & (j > self.first[j])
            inner &= numbers[np.maximum(place - 1, 0)] == self.numbers[np.maximum(j - 1, 0)]
            place, j = place[~inner], j[~inner]
            length = np.full(len(place), m)
            growing = np.arange(len(place))
            while len(growing):
                p, q = place[growing] + length[growing], j[growing] + length[growing]
                more = (p < end[place[growing]]) & (q < self.end[j[growing]])
                more &= numbers[np.minimum(p, len(numbers) - 1)] == self.numbers[q]
                growing = growing[more]
                length[growing] += 1
            places.append(place)
            lengths.append(length)
            items.append(self.item[j])
        return np.concatenate(places), np.concatenate(lengths), np.concatenate(items)


def _bisect(sorted_keys: np.ndarray, wanted: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of each wanted key within its own range of the array."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        here = sorted_keys[np.minimum(mid, len(sorted_keys) - 1)]
        up = open_ & ((here <= wanted) if right else (here < wanted))
        lo = np.where(up, mid + 1, lo)
        hi = np.where(open_ & ~up, mid, hi)
    return lo


def _matches(block, n_words: str, found_in: str):
    """Adds what one block finds to each row's list of maximal verbatim matches (start, length, item)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.schema.get_field_index(found_in)
            found = batch.column(column).to_pylist()
            count = np.zeros(batch.num_rows, dtype=np.int64)
            for first, last, data, bounds in text_slices(batch.column(batch.schema.get_field_index("text")), _SHARD_BYTES):
                words = words_of(data, bounds, ALNUM_LOWER)
                count[first:last] = np.diff(words.first)
                place, length, item = b.found(words)
                row = np.searchsorted(words.first, place, side="right") - 1
                for r, p, n, i in zip(row.tolist(), (place - words.first[row]).tolist(), length.tolist(), item.tolist(), strict=True):
                    found[first + r].append({"start": p, "length": n, "item": b.items[i]})
            kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("item", pa.string())]))
            out = batch.set_column(column, found_in, pa.array(found, type=kind))
            yield out.set_column(out.schema.get_field_index(n_words), n_words, pa.array(count))

    return run


def _searched(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> tuple[DataFrame, str, str]:
    """The rows with two more columns, and their names: the number of words and the matches."""
    spark = docs.sparkSession
    n_words, found = unused("words", docs), unused("found", docs)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / block_bytes))
    out = docs.withColumns({n_words: F.lit(0).cast("long"), found: F.array().cast(T.ArrayType(_FOUND))})
    written = None
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        sent = spark.sparkContext.broadcast(_Block([(r["item"], r["text"]) for r in part.toLocalIterator()], window))
        out = out.mapInArrow(_matches(sent, n_words, found), out.schema)
        if k < blocks - 1:
            out = durable(out)
            sent.destroy()
            if written is not None:
                release(written)
            written = out
    return out, n_words, found


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """One row per document: doc_id, text, n_words, n_hit, items (sorted ids of found items), longest (the
    longest verbatim match: length in words, start word, item; null if none)."""
    out, n_words, found = _searched(docs.select("doc_id", "text"), benchmark, window, block_bytes)
    covered = F.aggregate(
        F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("s"), (x["start"] + x["length"]).alias("e")))),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("e")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["e"]))).alias("n"),
            F.greatest(acc["e"], x["e"]).alias("e"),
        ),
        lambda acc: acc["n"].cast("long"),
    )
    longest = F.array_max(F.transform(found, lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("back"), x["item"].alias("item"))))
    return out.select(
        "doc_id", "text", F.col(n_words).alias("n_words"), covered.alias("n_hit"),
        F.array_sort(F.array_distinct(F.transform(found, lambda x: x["item"]))).alias("items"),
        F.when(longest.isNotNull(), F.struct(longest["length"].alias("length"), (-longest["back"]).alias("start"), longest["item"].alias("item"))).alias("longest"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """The documents in which no benchmark window occurs, with all their columns; one pass, no join."""
    out, n_words, found = _searched(docs, benchmark, window, block_bytes)
    return out.where(F.size(found) == 0).drop(n_words, found)
