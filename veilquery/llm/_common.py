"""Helpers that several training-data operators share: vectorised word hashing,
durable cuts of lineage, and connected components as joins."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SLICE_BYTES = 1 << 19


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir`` of the session.  One of our own is set only where
    none is named and everything runs in one process (tests, a laptop); on a cluster it has to be named."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="veilquery-checkpoint-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in :func:`shared_folder`."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(*frames: DataFrame) -> None:
    """Delete the files of :func:`durable` tables that nothing reads any more."""
    for df in frames:
        plan = df._jdf.queryExecution().logical()
        file = plan.rdd().getCheckpointFile()
        if file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """Like :func:`durable`, but as Parquet, in which tables of small numbers are far smaller.  Also its folder, for :func:`discard`."""
    folder = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def discard(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(name: str, df: DataFrame) -> str:
    """A name for a helper column that no column of the table has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name in taken:
        name += "_"
    return name


def sent_if_small(keys: DataFrame, *, rows: int = 1_000_000) -> DataFrame:
    """A key table, with the wish to broadcast it when a count shows at most ``rows`` of its rows;
    otherwise Spark joins it by shuffling both sides."""
    return F.broadcast(keys) if keys.limit(rows + 1).count() <= rows else keys


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, _SLICE_BYTES * 2)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[name] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class WordRule:
    """Which bytes belong to words, and whether A-Z count as a-z."""

    def __init__(self, is_word: np.ndarray, lower: bool):
        self.is_word = is_word
        self.values = _BYTE_VALUES.copy()
        if lower:
            self.values[65:91] = self.values[97:123]


def _space_separated() -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    return table


def _alphanumeric() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x41:0x5B] = True
    table[0x80:] = True
    return table


#: [^\x20\x09-\x0D]+ unchanged / with A-Z lowered; letters, digits and non-ASCII, lowered.
SPACED = WordRule(_space_separated(), lower=False)
SPACED_LOWER = WordRule(_space_separated(), lower=True)
ALNUM_LOWER = WordRule(_alphanumeric(), lower=True)


class Words:
    """The words of some consecutive texts: hashes, byte ranges, and the first word of each text."""

    __slots__ = ("data", "ends", "first", "hashes", "rows", "starts")

    def __init__(self, data, hashes, starts, ends, first, rows):
        self.data, self.hashes, self.starts, self.ends, self.first, self.rows = data, hashes, starts, ends, first, rows

    def grams(self, n: int) -> np.ndarray:
        """Hash of words i..i+n-1 for every i with that many words after it (texts are not kept apart)."""
        if len(self.hashes) < n:
            return np.empty(0, dtype=np.uint64)
        up, down = powers(len(self.hashes) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(self.hashes) + 1, dtype=np.uint64)
            np.cumsum(self.hashes * up[: len(self.hashes)], out=total[1:])
            return mix((total[n:] - total[:-n]) * down[: len(total) - n])

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def text_slices(texts: pa.Array, size: int = _SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows of a text column, about ``size`` bytes at a time (a longer text comes alone):
    first row, row after the last, bytes, and where each text begins and ends in them.  Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words_of(data: np.ndarray, bounds: np.ndarray, rule: WordRule) -> Words:
    """Words of the texts data[bounds[k]:bounds[k+1]], hashed by bytes."""
    n, rows = len(data), len(bounds) - 1
    if n == 0:
        empty = np.empty(0, dtype=np.int64)
        return Words(data, np.empty(0, dtype=np.uint64), empty, empty, np.zeros(rows + 1, dtype=np.int64), rows)
    inside = rule.is_word[data]
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    inner = bounds[1:-1]
    before[inner[inner < n]] = False
    after[inner[inner > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(rule.values[data] * up[:n], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * down[starts])
    return Words(data, hashes, starts, ends, np.searchsorted(starts, bounds), rows)


def components(links: DataFrame, *, rounds: int = 40) -> DataFrame:
    """Connected components of links (a, b): returns (id, component), component the smallest id reachable.

    Alternates "every node to the smallest neighbour of its larger side" and "of its
    smaller side" (large star, small star) until nothing changes; each step is a
    partial aggregation and a join, so a node with very many links is no group of its
    own.  Nulls and loops are ignored; only ids that have a link are returned."""
    edges = durable(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(down.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        before, edges = edges, durable(small)
        release(before)
        # done when every node has one edge, to a node that has none
        twice = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        further = edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi")
        if not twice.unionByName(further).limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
