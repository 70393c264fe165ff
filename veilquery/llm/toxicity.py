"""Toxicity by two class-conditional Kneser-Ney models.

Each class (toxic, ordinary) has an interpolated Kneser-Ney model of word pairs.  A count is
the number of labelled documents of the class that have a pair; a word's continuation count is
the number of distinct words before it; discounts come from the counts of counts, for each
class and order.  Below both classes lies one shared distribution: the words' document
frequencies over *all* documents, labelled or not.

An expression (word or pair) keeps the estimates of its class only if the classes differ
in it for certain: the ratio of its document rates, less ``sure`` standard errors, exceeds
``least``.  All other expressions, rare ones above all, get shared counts in both classes and
say nothing.  What distinguishes the classes is thus a small table: the models' log-ratio
is a sum over a text's words of entries for the decided words, the decided pairs and their
contexts.  The score is a logistic curve over the length-normalised difference of the
two log-likelihoods, fitted on labelled documents that were kept out of the counts (fold 1).

Counts and curve take every labelled row, and the shared counts every document.  Nothing of theirs passes through the
driver but sums; labels go to the tasks up to a counted million rows and are joined by shuffling beyond that.  All decided
expressions count.  If there are more than ``most_decided``, only the commonest, at most that many, are sent to the tasks,
and all others are joined with the words of the different texts by shuffling; the scores are the same.  What they add to
each text then stays below the checkpoint folder, as the scores are read from it.

Learning never uses labels of rows whose crc32(doc_id as text) mod 5 is 0, nor lang, source or doc_id.
Null or empty text has no words and gets the score of no evidence.  A null doc_id is
never learned from and is not held out.  Of repeated labels the larger counts; null
labels count as none.  Repeated documents count as often as they occur.  Without labels of both
classes every score is the share of toxic labels (0 without any).  Extra columns are kept by
:func:`without_toxic`, whatever their names, and ignored by :func:`toxicity`.  Empty tables
give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilquery.llm._common import ALNUM_LOWER, Words, discard, durable, mix, release, sent_if_small, stored, text_slices, unused, words_of

#: The context of a text's first word.
_BEGIN = np.uint64(0x9E3779B97F4A7C15)
_HELD = 1 << 20  # rows
_WORD, _PAIR, _CONTEXT = 0, 1, 2
_SHIFT = 37  # 2^27 marks, 16 MB
_COUNTS = "before long, word long, docs int, n0 int, n1 int"


def _contexts(words: Words) -> np.ndarray:
    """The word before each word."""
    before = np.concatenate([[_BEGIN], words.hashes[:-1]]) if len(words.hashes) else words.hashes
    first = words.first[:-1]
    before[first[first < len(before)]] = _BEGIN
    return before


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(before * np.uint64(3) + mix(word))


def context_hash(before: np.ndarray) -> np.ndarray:
    return mix(before ^ _BEGIN)


class _Tally:
    """Sums of counts by keys (64-bit hashes), as far as they have come; never many more than ``_HELD`` rows."""

    def __init__(self, keys: int, counts: int):
        self.keys, self.columns, self.rows = keys, [[] for _ in range(keys + counts)], 0

    def add(self, *columns: np.ndarray) -> bool:
        """Whether there is enough to be passed on."""
        for own, values in zip(self.columns, columns, strict=True):
            own.append(values)
        self.rows += len(columns[0])
        if self.rows > _HELD:
            own = self.taken()
            for column, values in zip(self.columns, own, strict=True):
                column.append(values)
            self.rows = len(own[0])
            return self.rows > _HELD // 2
        return False

    def taken(self) -> list[np.ndarray]:
        """The sums so far, which are forgotten."""
        every = [np.concatenate(c) for c in self.columns]
        for c in self.columns:
            c.clear()
        self.rows = 0
        keys, counts = every[: self.keys], every[self.keys :]
        _, one, at = np.unique(pair_hash(*keys) if self.keys == 2 else keys[0], return_index=True, return_inverse=True)
        sums = [*(k[one] for k in keys), *(np.bincount(at, weights=n, minlength=len(one)).astype(np.int32) for n in counts)]
        # rows of a word stand together, as they then take less room in the shuffle
        order = np.argsort(sums[1], kind="stable") if self.keys == 2 else slice(None)
        return [s[order] for s in sums]


def _once(words: Words, keys: np.ndarray) -> np.ndarray:
    """The places of each text's different keys, and the texts they stand in."""
    text = np.repeat(np.arange(words.rows), np.diff(words.first))
    order = np.lexsort((keys, text))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (text[order][1:] != text[order][:-1])
    return order[new], text[order[new]]


def _table(before: pa.Array, word: np.ndarray, *counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([before, pa.array(word.view(np.int64)), *map(pa.array, counts)], ["before", "word", "docs", "n0", "n1"])


def _pairs_once(words: Words, kind: np.ndarray) -> list[np.ndarray]:
    """before, word, n0, n1 of the pairs of learned texts (kind 0 or 1), each once a text."""
    before = _contexts(words)
    at, text = _once(words, pair_hash(before, words.hashes))
    keep = kind[text] < 2
    at, kinds = at[keep], kind[text[keep]]
    return [before[at], words.hashes[at], kinds == 0, kinds == 1]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that have each word (before null): all, and the learned ones of each class; and learned ones that have each pair."""
    tallies = {"word": _Tally(1, 3), "pair": _Tally(2, 2)}

    def table(name: str) -> pa.RecordBatch:
        own = tallies[name].taken()
        if name == "word":
            return _table(pa.nulls(len(own[0]), pa.int64()), *own)
        return _table(pa.array(own[0].view(np.int64)), own[1], np.zeros(len(own[0]), dtype=np.int32), *own[2:])

    for batch in batches:
        group = batch.column(1).fill_null(2).to_numpy(zero_copy_only=False)
        for first, last, data, bounds in text_slices(batch.column(0)):
            words, kind = words_of(data, bounds, ALNUM_LOWER), group[first:last]
            at, text = _once(words, words.hashes)
            kinds = kind[text]
            if tallies["word"].add(words.hashes[at], np.ones(len(at), dtype=np.int32), kinds == 0, kinds == 1):
                yield table("word")
            if (kind < 2).any() and tallies["pair"].add(*_pairs_once(words, kind)):
                yield table("pair")
    for name, tally in tallies.items():
        if tally.rows:
            yield table(name)


def _sureness(n0: Column, n1: Column, t0: int, t1: int, least: float) -> Column:
    """By how many standard errors the log-ratio of document rates exceeds ``least`` in either direction."""
    ratio = F.log((n1 + 0.5) / t1) - F.log((n0 + 0.5) / t0)
    return (F.abs(ratio) - least) / F.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))


def discount(ones: float, twos: float) -> float:
    """The Kneser-Ney discount, from the numbers of types counted once and twice."""
    return ones / (ones + 2 * twos) if ones else 0.5


@dataclass
class Model:
    """Sorted keys and what each adds to the difference of the log-likelihoods; ``rest`` is added by every other word.
    ``beyond`` holds the key and value of all expressions that are too many to be sent, if there are such."""

    words: np.ndarray
    word_values: np.ndarray
    pairs: np.ndarray
    pair_values: np.ndarray
    contexts: np.ndarray
    context_values: np.ndarray
    rest: float
    beyond: DataFrame | None = None

    def differences(self, texts: pa.Array, more: np.ndarray | None = None) -> np.ndarray:
        """Per text: (toxic - ordinary log-likelihood) / number of words; more: what the expressions beyond add to the first."""
        out = np.zeros(len(texts))
        for first, last, data, bounds in text_slices(texts):
            words = words_of(data, bounds, ALNUM_LOWER)
            if not len(words.hashes):
                continue
            before = _contexts(words)
            own = _looked_up(self.words, self.word_values, words.hashes, self.rest)
            if len(self.contexts):
                own += _looked_up(self.contexts, self.context_values, before, 0.0) + _looked_up(self.pairs, self.pair_values, pair_hash(before, words.hashes), 0.0)
            total = np.concatenate([[0.0], np.cumsum(own)])
            count = np.diff(words.first)
            sums = total[words.first[1:]] - total[words.first[:-1]]
            out[first:last] = (sums if more is None else sums + more[first:last]) / np.maximum(count, 1)
        return out


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, otherwise: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), otherwise)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], otherwise)


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], values[order]


def fitted_model(docs: DataFrame, known: DataFrame, *, sure: float, pair_sure: float, least: float, most_decided: int) -> Model | None:
    """docs: doc_id, text; known: doc_id, toxic of the rows to learn from.  None without rows of both classes."""
    learned = docs.join(known, "doc_id", "left").select("text", "toxic")
    totals = learned.where("toxic is not null").groupBy("toxic").count().collect()
    t = [max((r["count"] for r in totals if r["toxic"] == c), default=0) for c in (0, 1)]
    if not all(t):
        return None
    pair, n0, n1 = F.col("before").isNotNull(), F.col("n0"), F.col("n1")
    # dealt by word, so that the words need no shuffle of their own; tasks have summed a common word's pairs before
    counted = (
        learned.mapInArrow(_count, _COUNTS).repartition("word")
        .groupBy("word", "before").agg(F.sum("docs").alias("docs"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    )
    # words with their continuation counts, parts of the pairs' counts of counts, and the pairs that may be decided
    by_word = counted.groupBy("word").agg(
        F.sum("docs").alias("docs"), F.sum(F.when(~pair, n0)).alias("n0"), F.sum(F.when(~pair, n1)).alias("n1"),
        F.count_if(pair & (n0 > 0)).alias("a"), F.count_if(pair & (n1 > 0)).alias("b"), F.count_if(pair).alias("c"),
        *(F.count_if(pair & (F.col(f"n{k}") == n)).alias(f"pairs{k}_{n}") for k in (0, 1) for n in (1, 2)),
        F.collect_list(F.when(pair & (_sureness(n0, n1, *t, least) >= pair_sure), F.struct(F.col("before").alias("key"), n0.alias("a"), n1.alias("b")))).alias("pairs"),
    )
    # contexts with their totals and numbers of types; all columns, so that both tables come from one shuffle
    by_context = counted.groupBy("before").agg(
        F.sum("docs").alias("docs"), F.count_if(n0 > 0).alias("n0"), F.count_if(n1 > 0).alias("n1"), F.sum("n0").alias("a"), F.sum("n1").alias("b")
    )
    both = by_word.withColumn("is_word", F.lit(True)).unionByName(by_context.withColumnRenamed("before", "word").withColumn("is_word", F.lit(False)), allowMissingColumns=True)
    table, folder = stored(both)  # written once, as all that follows is made from it
    words, about = table.where("is_word"), table.where("not is_word and word is not null").selectExpr("word as key", "a as full0", "b as full1", "n0 as types0", "n1 as types1")
    words = words.withColumn("sureness", _sureness(n0, n1, *t, least))
    seen = lambda c, n: F.count_if(F.col(c) == n)
    whole = words.agg(F.sum("docs").alias("docs"), *(F.sum(f"pairs{k}_{n}").alias(f"pairs{k}_{n}") for k in (0, 1) for n in (1, 2)), *(f(c).alias(f"{name}{c}") for c in "abc" for name, f in (
        ("sum_", F.sum), ("types_", lambda c: F.count_if(F.col(c) > 0)), ("ones_", lambda c: seen(c, 1)), ("twos_", lambda c: seen(c, 2))))).first()
    whole = {name: n or 0 for name, n in whole.asDict().items()}

    def kneser_ney(c: str) -> Column:
        d, total = discount(whole[f"ones_{c}"], whole[f"twos_{c}"]), max(whole[f"sum_{c}"], 1)
        return F.greatest(F.col(c) - d, F.lit(0.0)) / total + d * whole[f"types_{c}"] / total * F.col("docs") / max(whole["docs"], 1)

    own = F.col("sureness") >= sure
    kept = {c: n or 0.0 for c, n in words.where(own).agg(*(F.sum(kneser_ney(c)).alias(c) for c in "abc")).first().asDict().items()}
    # what the decided words leave to all others, by class
    scale = [max(1 - kept[c], 1e-9) / max(1 - kept["c"], 1e-9) for c in "ab"]
    rest = float(np.log(scale[1]) - np.log(scale[0]))
    positive = lambda p: F.greatest(p, F.lit(1e-300))
    words = words.select("word", "pairs", own.alias("own"), (n0 + n1).alias("n"), *(
        positive(F.when(own, kneser_ney(c)).otherwise(kneser_ney("c") * scale[k])).alias(f"low{k}") for k, c in enumerate("ab")))
    # the decided pairs, with the probabilities of their words and with the totals of their contexts
    two = words.select("word", "low0", "low1", F.inline("pairs"))
    two = about.join(sent_if_small(two), "key")

    def probability(k: int, count: str) -> Column:
        d, full = discount(whole[f"pairs{k}_1"], whole[f"pairs{k}_2"]), F.nullif(F.col(f"full{k}"), F.lit(0))
        return positive(F.coalesce(F.greatest(F.col(count) - d, F.lit(0.0)) / full + d * F.col(f"types{k}") / full * F.col(f"low{k}"), F.col(f"low{k}")))

    two = two.withColumns({"p0": probability(0, "a"), "p1": probability(1, "b")})
    left = [F.log(F.greatest(1 - F.sum(f"p{k}"), F.lit(1e-9))) - F.log(F.greatest(1 - F.sum(f"low{k}"), F.lit(1e-9))) for k in (0, 1)]
    contexts = two.groupBy("key").agg((left[1] - left[0]).alias("left"), F.first(F.col("full0") + F.col("full1")).alias("full"))
    single, joint = (F.log(f"{p}1") - F.log(f"{p}0") for p in ("low", "p"))
    values, kept_in = stored(
        words.where("own").select(F.lit(_WORD).alias("kind"), F.lit(0).cast("long").alias("before"), "word", single.alias("value"), "n")
        .unionByName(contexts.select(F.lit(_CONTEXT).alias("kind"), F.col("key").alias("before"), F.lit(0).cast("long").alias("word"), F.col("left").alias("value"), F.col("full").alias("n")))
        .unionByName(two.join(contexts, "key").select(F.lit(_PAIR).alias("kind"), F.col("key").alias("before"), "word", (joint - single - F.col("left")).alias("value"), (F.col("a") + F.col("b")).alias("n")))
    )
    discard(learned.sparkSession, folder)
    common, beyond = 0, None
    if values.limit(most_decided + 1).count() > most_decided:
        room = most_decided
        for n, expressions in values.groupBy("n").count().orderBy(F.desc("n")).collect():
            room -= expressions
            if room < 0:
                common = n + 1
                break
        # to a word's rest, which every word adds
        others = values.where(F.col("n") < common).withColumn("value", F.col("value") - F.when(F.col("kind") == _WORD, rest).otherwise(0.0))
        beyond = durable(others.select("kind", "before", "word", "value").mapInArrow(_keyed, "key long, value double"))
    sent = {c: x.to_numpy() for c, x in zip(values.columns, values.where(F.col("n") >= common).toArrow().columns, strict=True)}
    discard(learned.sparkSession, kept_in)
    before, word = sent["before"].view(np.uint64), sent["word"].view(np.uint64)
    tables = []
    for kind, keys in ((_WORD, lambda at: word[at]), (_PAIR, lambda at: pair_hash(before[at], word[at])), (_CONTEXT, lambda at: before[at])):
        at = sent["kind"] == kind
        tables += _sorted(keys(at), sent["value"][at])
    return Model(*tables, rest, beyond)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One key for each word, pair or context (kind, before, word, value), and its value."""
    for batch in batches:
        kind, before, word = (batch.column(k).to_numpy() for k in range(3))
        before, word = before.view(np.uint64), word.view(np.uint64)
        keys = np.where(kind == _WORD, word, np.where(kind == _PAIR, pair_hash(before, word), context_hash(before)))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(3)], ["key", "value"])


def _added(docs: DataFrame, beyond: DataFrame) -> DataFrame:
    """What the expressions beyond those sent add to each different text that has any: digest, more."""
    # marks of the keys by their first bits, so that few other words are shuffled
    mark = F.shiftrightunsigned("key", _SHIFT)
    marks = np.zeros((1 << 12, 1 << 12), dtype=np.uint8)
    for part, own in beyond.groupBy(F.shiftright(mark, 15)).agg(F.bitmap_construct_agg(mark.bitwiseAND(0x7FFF))).collect():
        marks[part] = np.frombuffer(own, dtype=np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(marks.ravel())

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, bounds in text_slices(batch.column(1)):
                words = words_of(data, bounds, ALNUM_LOWER)
                before = _contexts(words)
                keys = np.concatenate([words.hashes, pair_hash(before, words.hashes), context_hash(before)])
                text = np.tile(np.repeat(np.arange(words.rows), np.diff(words.first)), 3)
                bit = keys >> np.uint64(_SHIFT)
                some = np.flatnonzero(sent.value[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
                some = some[np.lexsort((keys[some], text[some]))]
                keys, text = keys[some], text[some]
                new = np.ones(len(keys), dtype=bool)
                new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
                at = np.flatnonzero(new)
                counts = np.diff(np.append(at, len(keys)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + text[at])), pa.array(keys[at].view(np.int64)), pa.array(counts)], ["digest", "key", "n"])

    rows = docs.where("text is not null").select(_digest().alias("digest"), "text").mapInArrow(used, "digest binary, key long, n long").distinct()
    return durable(rows.join(beyond, "key").groupBy("digest").agg(F.sum(F.col("n") * F.col("value")).alias("more")))


def _digest() -> Column:
    return F.unhex(F.md5("text"))


def _with_added(rows: DataFrame, added: DataFrame | None, name: str) -> DataFrame:
    """The rows and, as their last column, what expressions beyond those sent add to their texts."""
    if added is None:
        return rows.withColumn(name, F.lit(0.0))
    digest = unused("digest", rows)
    found = sent_if_small(added).select(F.col("digest").alias(digest), F.col("more").alias(name))
    return rows.withColumn(digest, _digest()).join(found, digest, "left").drop(digest).withColumn(name, F.coalesce(name, F.lit(0.0)))


def _features(difference: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(difference)), 100 * difference])


def _fit(rows: DataFrame, ridge: float = 0.001) -> np.ndarray:
    """Logistic regression of toxic on the :func:`_features` of difference, by Newton's method; every step sums over all rows."""
    w, x = np.zeros(2), 100 * F.col("difference")
    for _ in range(60):
        p = 1 / (1 + F.exp(-F.least(F.greatest(F.lit(float(w[0])) + float(w[1]) * x, F.lit(-30.0)), F.lit(30.0))))
        own = rows.select(x.alias("x"), (p * (1 - p)).alias("v"), (F.col("toxic") - p).alias("e"))
        v, vx, vxx, e, ex = own.agg(F.sum("v"), F.sum(F.col("v") * F.col("x")), F.sum(F.col("v") * F.col("x") * F.col("x")), F.sum("e"), F.sum(F.col("e") * F.col("x"))).first()
        step = np.linalg.solve(np.array([[v, vx], [vx, vxx]]) + ridge * np.eye(2), np.array([e, ex]) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored, name = with_scores(docs.select("doc_id", "text"), labels, **options)
    return scored.select(
        "doc_id", F.coalesce(_fold() == 0, F.lit(False)).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents, with all their columns, whose score is below a half."""
    scored, name = with_scores(docs, labels, **options)
    return scored.where(F.col(name) < 0.5).drop(name)


def _fold():
    return F.crc32(F.col("doc_id").cast("string")) % 5


def with_scores(
    every: DataFrame, labels: DataFrame, *, sure: float = 2.0, pair_sure: float = 5.0, least: float = 1.0, most_decided: int = 500_000,
) -> tuple[DataFrame, str]:
    """All rows and columns, and a column of scores; its name, which none of the rows' own columns has."""
    spark = every.sparkSession
    docs = every.select("doc_id", "text")
    known = durable(
        labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .withColumn("fold", _fold()).where("fold <> 0")
    )
    model = fitted_model(
        docs, sent_if_small(known.where("fold > 1").select("doc_id", "toxic")), sure=sure, pair_sure=pair_sure, least=least, most_decided=most_decided
    )
    curve, base = None, known.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0]
    sent, added = spark.sparkContext.broadcast(model and replace(model, beyond=None)), None
    if model is not None:
        if model.beyond is not None:
            added = _added(docs, model.beyond)
            release(model.beyond)

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(sent.value.differences(batch.column(0), batch.column(2).to_numpy())), batch.column(1)], ["difference", "toxic"])

        chosen = sent_if_small(known.where("fold = 1").select("doc_id", "toxic"))
        rows = durable(_with_added(docs.join(chosen, "doc_id").select("text", "toxic"), added, "more").mapInArrow(measured, "difference double, toxic int"))
        least_toxic, most_toxic = rows.agg(F.min("toxic"), F.max("toxic")).first()
        if least_toxic != most_toxic:
            curve = _fit(rows)
        release(rows)
    release(known)
    name = unused("score", every)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if curve is None:
                score = np.full(batch.num_rows, float(base))
            else:
                texts, more = batch.column(batch.schema.get_field_index("text")), batch.column(batch.num_columns - 1).to_numpy()
                score = 1 / (1 + np.exp(-np.clip(_features(sent.value.differences(texts, more)) @ curve, -30, 30)))
            yield batch.set_column(batch.num_columns - 1, name, pa.array(score))

    rows = _with_added(every, added, name)
    return rows.mapInArrow(scored, rows.schema), name
