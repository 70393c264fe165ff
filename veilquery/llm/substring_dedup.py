"""Removal of long passages that a smaller doc_id already has.

Matching is done by suffix automata over words.  Every window of ``window`` words has
an anchor: the smallest hash among its runs of ``anchor`` words, so equal windows have
equal anchors wherever they stand.  Anchors that occur in two documents at least mark
the only places where a window can repeat.  The passage of windows around such an
anchor goes to the anchor's shard; equal passages go there once, with the smallest
doc_id that has them.  A shard is one suffix automaton, built from its passages in the
order of doc_id; every passage is streamed through the automaton of those before it,
and where the matching statistic reaches the window's length in a state whose first
occurrence is in a smaller document, the window is removed.  Maximal runs of removed
windows are the spans.

A shard holds about ``shard_words`` words.  An anchor with more than ``split_passages``
different passages would not fit one: its passages are taken for documents and dealt
out anew by longer anchors (half of the words that are still free each time, a whole
window in the end, of which there is one passage), so one way decides all of them.

Nulls: null text has no words; a document whose doc_id is null neither loses words nor
takes any.  Texts shorter than a window are kept.  Repeated rows with the same doc_id
do not take words from each other; with equal doc_id and different text each is
answered for itself.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilquery.llm._common import SPACED, Words, durable, mix, powers, sent_if_small, text_slices, words_of

_POSITION_BITS = 28


def _anchors(words: Words, window: int, size: int) -> tuple[np.ndarray, ...]:
    """Row, anchor hash, passage hash, first and last window of each run of windows with one anchor."""
    none = (np.empty(0, np.int64),) * 5
    lengths = np.diff(words.first)
    count = np.maximum(lengths - window + 1, 0)
    if not count.sum():
        return none
    grams = words.grams(size)
    place = np.uint64((1 << _POSITION_BITS) - 1)
    best = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
    span, done = window - size + 1, 1
    while done * 2 <= span:
        best = np.minimum(best[:-done], best[done:])
        done *= 2
    if done < span:
        best = np.minimum(best[: len(best) - (span - done)], best[span - done :])
    row = np.repeat(np.arange(len(lengths)), count)
    start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + words.first[row]
    anchor = (best[start] & place).astype(np.int64)
    edge = np.flatnonzero((anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])) + 1
    first = np.concatenate([[0], edge])
    last = np.concatenate([edge, [len(row)]]) - 1
    up, down = powers(len(words.hashes) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(words.hashes) + 1, dtype=np.uint64)
        np.cumsum(mix(words.hashes + np.uint64(77)) * up[: len(words.hashes)], out=total[1:])
        a, b = start[first], start[last] + window
        passage = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
    base = words.first[row[first]]
    return row[first], grams[anchor[first]].view(np.int64), passage.view(np.int64), start[first] - base, start[last] - base


def _marks(window: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, bounds in text_slices(batch.column(2)):
                row, anchor, passage, a, b = _anchors(words_of(data, bounds, SPACED), window, size)
                if len(row):
                    take = pa.array(row + first)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor), pa.array(passage), batch.column(0).take(take), batch.column(1).take(take), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))],
                        ["anchor", "passage", "doc_id", "own", "first", "last"],
                    )

    return run


def _passages(window: int):
    """The words of each passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("anchor", "passage", "doc_id", "words")}
            for doc_id, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = text.encode().split()
                for w in wanted:
                    passage = b" ".join(words[w["first"] : w["last"] + window]).decode()
                    for k, v in zip(out, (w["anchor"], w["passage"], doc_id, passage), strict=True):
                        out[k].append(v)
            kinds = {"anchor": pa.int64(), "passage": pa.int64(), "doc_id": batch.schema.field(0).type, "words": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in out.items()], list(out))

    return run


class Automaton:
    """Suffix automaton of several word sequences; each state knows the smallest document that has its strings."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [None]

    def _state(self, length: int, least, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.least.append(least)
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """The state for the strings of q that also end at p's extension by w."""
        nxt, link = self.next, self.link
        clone = self._state(self.length[p] + 1, self.least[q], link[q], dict(nxt[q]))
        link[q] = clone
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone

    def add(self, words: list[int], document) -> None:
        """Documents come in rising order, so a state's first document is its smallest."""
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, q, w)
                continue
            new = self._state(length[last] + 1, document, 0, {})
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, q, w)
            last = new

    def repeats(self, words: list[int], document, window: int) -> list[tuple[int, int]]:
        """Maximal spans covered by windows that a smaller document has."""
        nxt, link, length, least = self.next, self.link, self.length, self.least
        spans: list[tuple[int, int]] = []
        s = matched = 0
        for i, w in enumerate(words):
            while s and w not in nxt[s]:
                s = link[s]
                matched = length[s]
            t = nxt[s].get(w)
            if t is None:
                continue
            s, matched = t, matched + 1
            while length[link[s]] >= window:
                s = link[s]
                matched = length[s]
            if matched >= window and least[s] < document:
                if spans and spans[-1][1] >= i + 1 - window:
                    spans[-1] = (spans[-1][0], i + 1)
                else:
                    spans.append((i + 1 - window, i + 1))
        return spans


def _shard(window: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["anchor", "passage"]).sort_values(["doc_id", "anchor", "passage"], kind="stable")
        automaton, numbers = Automaton(), {}
        starts, ends = [], []
        for text, document in zip(rows["words"], rows["doc_id"].tolist(), strict=True):
            words = [numbers.setdefault(w, len(numbers)) for w in text.split(" ")]
            spans = automaton.repeats(words, document, window)
            automaton.add(words, document)
            starts.append([a for a, _ in spans])
            ends.append([b for _, b in spans])
        return pd.DataFrame({"anchor": rows["anchor"], "passage": rows["passage"], "least": rows["doc_id"], "starts": starts, "ends": ends})

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = (text or "").encode().split()
            n_words.append(len(words))
            if spans:
                edges = np.zeros(len(words) + 1, dtype=np.int64)
                for s in spans:
                    edges[s["a"]] += 1
                    edges[s["b"]] -= 1
                words = list(compress(words, np.cumsum(edges[:-1]) == 0))
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words).decode())
        columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])


def _identified(docs: DataFrame) -> DataFrame:
    """Documents that have an id, with the hash of their text."""
    return docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("own"), "text")


def repeated_spans(
    docs: DataFrame, *, window: int = 50, anchor: int = 12, shard_words: int = 60_000, split_passages: int = 1500
) -> DataFrame:
    """Word spans [a, b) to remove: doc_id, own (hash of the text), spans."""
    return _spans(_identified(docs), window, anchor, shard_words, split_passages)[0]


def _spans(own: DataFrame, window: int, anchor: int, shard_words: int, split_passages: int) -> tuple[DataFrame, DataFrame]:
    """The spans, and the keys of the only documents that can have any."""
    id_type = own.schema["doc_id"].dataType.simpleString()
    marks = own.select("doc_id", "own", "text").mapInArrow(
        _marks(window, anchor), f"anchor long, passage long, doc_id {id_type}, own long, first int, last int"
    )
    # written first, so that both sides of the join are plain shuffles and Spark can split a common anchor
    shared = durable(marks.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor"))
    marks = durable(marks.join(shared, "anchor", "left_semi"))
    least = durable(
        marks.groupBy("anchor", "passage").agg(F.min(F.struct("doc_id", "own", "first", "last")).alias("m")).select("anchor", "passage", "m.*")
    )
    touched = sent_if_small(durable(marks.select("doc_id", "own").distinct()))
    own = own.join(touched, ["doc_id", "own"], "left_semi")
    hot = sent_if_small(durable(least.groupBy("anchor").count().where(F.col("count") > split_passages).select("anchor")))
    total = least.agg(F.coalesce(F.sum(F.col("last") - F.col("first") + window), F.lit(0))).first()[0]
    shards = max(1, math.ceil(total / shard_words))

    def passages(of: DataFrame) -> DataFrame:
        wanted = of.groupBy("doc_id", "own").agg(F.collect_list(F.struct("anchor", "passage", "first", "last")).alias("wanted"))
        return own.join(wanted, ["doc_id", "own"]).select("doc_id", "text", "wanted").mapInArrow(
            _passages(window), f"anchor long, passage long, doc_id {id_type}, words string"
        )

    any_hot = anchor < window and hot.limit(1).count() > 0
    removed = (
        passages(least.join(hot, "anchor", "left_anti") if any_hot else least)
        .groupBy(F.pmod(F.hash("anchor"), F.lit(shards)).alias("shard"))
        .applyInPandas(_shard(window), f"anchor long, passage long, least {id_type}, starts array<int>, ends array<int>")
    )
    if any_hot:
        as_own = F.xxhash64("anchor", "passage").alias("own")
        parts = durable(passages(least.join(hot, "anchor", "left_semi")).select("doc_id", as_own, F.col("words").alias("text")))
        longer = window if window - anchor < 16 else (anchor + window + 1) // 2
        # a passage of which no smaller document has a window has no spans there
        within = _spans(parts, window, longer, shard_words, split_passages)[0]
        removed = removed.unionByName(
            least.join(hot, "anchor", "left_semi").withColumn("own", as_own)
            .join(within, ["doc_id", "own"], "left")
            .select("anchor", "passage", F.col("doc_id").alias("least"), F.col("spans.a").alias("starts"), F.col("spans.b").alias("ends"))
        )
    pair = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    whole = F.array(pair(F.col("first"), F.col("last") + window))
    part = F.zip_with("starts", "ends", lambda a, b: pair(F.col("first") + a, F.col("first") + b))
    spans = (
        marks.join(removed, ["anchor", "passage"])
        .withColumn("spans", F.when(F.col("doc_id") > F.col("least"), whole).otherwise(part))
        .where(F.size("spans") > 0)
        .groupBy("doc_id", "own").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    )
    return spans, touched


def remove_repeats(
    docs: DataFrame, *, window: int = 50, anchor: int = 12, shard_words: int = 60_000, split_passages: int = 1500
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (its kept words, joined by one space)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", F.xxhash64("text").alias("own"), "text")
    spans, touched = _spans(_identified(docs), window, anchor, shard_words, split_passages)
    known = own.join(touched, ["doc_id", "own"], "left_semi").join(spans, ["doc_id", "own"], "left").select("doc_id", "text", "spans")
    # documents without a shared anchor need no join with the spans
    rest = own.join(touched, ["doc_id", "own"], "left_anti").select("doc_id", "text", F.lit(None).cast("array<struct<a:int,b:int>>").alias("spans"))
    return known.unionByName(rest).mapInArrow(_cut, f"doc_id {id_type}, n_words long, n_removed long, kept string")
