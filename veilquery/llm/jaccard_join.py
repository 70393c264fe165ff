"""Near-duplicates by word n-gram Jaccard similarity, with token-combination prefixes.

A document is its set of distinct word n-grams (64-bit hashes).  Tokens fall into classes by
document frequency, with an absolute bound (``rare`` documents), so that no bucket of the
index grows with the corpus unless its documents are mostly made of frequent tokens:

1. *Single tokens, prefix of all sets.*  Every set's prefix by hash, a quarter longer than
   the one that must hold a common token of similar sets, is indexed by single tokens.  A
   token in more than ``rare`` prefixes is frequent and no key.  Two similar sets whose
   prefixes of length (tokens that may be missing + k) share k tokens at least share a rare
   one unless both have k frequent tokens there; sets with so many are *hard*.
2. *Single tokens, whole hard sets.*  Among the hard sets frequencies are counted anew over
   all their tokens, rare tokens come first, and prefixes of rare tokens are indexed.
3. *Pairs of frequent tokens.*  What still lacks rare tokens (nearly all of its tokens are
   frequent: large groups of near copies) extends its prefix over frequent tokens, less one in
   each cell of the hash space: two similar sets then share two frequent tokens of one cell.
   Members of a bucket are verified against two leaders only; members of a cluster of
   connected buckets that are then in different components are compared in blocks.

Candidates are refuted by their sizes, by the number of rare tokens that their prefixes must
share, and by odd sketches (the parity of the tokens in each of 512 cells; the sets differ in
at least as many tokens as the sketches in bits).  What remains is verified on whole sets.
No step drops a pair that is similar.

Equal sets are one representative (the smallest doc_id), so a large group of copies is never
expanded into pairs.  The blocks of a cluster hold about ``block_docs`` sets and 500 times as many
tokens; the work in one cluster grows with the product of its members and of those outside its
largest component.

Null, empty or word-less text: an empty set, linked with nothing.  A row whose doc_id is
null links with nothing and gets a null component.  Repeated rows are equal sets.  Only
doc_id and text are read.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilquery.llm._common import SPACED_LOWER, components, durable, mix, powers, release, sent_if_small, text_slices, words_of

_SKETCH = [f"o{i}" for i in range(8)]


def _sets(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of each text that has words."""
    for first, _, data, bounds in text_slices(texts):
        words = words_of(data, bounds, SPACED_LOWER)
        grams = words.grams(size)
        for k in range(words.rows):
            a, b = int(words.first[k]), int(words.first[k + 1])
            if b - a >= size:
                yield first + k, np.unique(grams[a : b - size + 1])
            elif b > a:
                with np.errstate(over="ignore"):
                    up, _ = powers(size)
                    whole = mix(np.array([np.sum(words.hashes[a:b] * up[: b - a], dtype=np.uint64) + np.uint64(b - a)]))
                yield first + k, whole


def odd_sketch(tokens: np.ndarray) -> np.ndarray:
    """512 bits: whether each cell of the hash space holds an odd number of tokens."""
    cells = (mix(tokens ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(55)).astype(np.int64)
    return np.packbits((np.bincount(cells, minlength=512) & 1).astype(np.uint8)).view(np.int64)


def _profile(size: int):
    """For each document its set's size, digest and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            n = np.zeros(rows, dtype=np.int32)
            digest = np.zeros((2, rows), dtype=np.uint64)
            sketch = np.zeros((rows, 8), dtype=np.int64)
            with np.errstate(over="ignore"):
                for k, tokens in _sets(batch.column(1), size):
                    n[k] = len(tokens)
                    digest[0, k] = np.sum(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)
                    digest[1, k] = np.sum(mix(tokens + np.uint64(0x14057B7EF767814F)), dtype=np.uint64)
                    sketch[k] = odd_sketch(tokens)
            columns = [batch.column(0), pa.array(n), *(pa.array(d.view(np.int64)) for d in digest), *(pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(8))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "d1", "d2", *_SKETCH])

    return run


def prefix_need(n, share: int):
    """Tokens of a set of n of which a similar set has one at least (columns and whole numbers alike)."""
    return n - _div(share * n + 99, 100) + 1


def prefix_length(n, share: int):
    """The indexed prefix: a quarter longer, so that frequent tokens need not stand for rare ones."""
    longer = _div(5 * prefix_need(n, share) + 3, 4) + 1
    return F.least(n, longer) if isinstance(n, Column) else min(n, longer)


def _div(a, b: int):
    return F.call_function("div", a, F.lit(b)).cast("int") if isinstance(a, Column) else a // b


def _tokens(size: int, share: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows, counts = [], [], []
            for k, tokens in _sets(batch.column(1), size):
                keys.append(tokens if whole else tokens[: prefix_length(len(tokens), share)])
                rows.append(k)
                counts.append(len(keys[-1]))
            if keys:
                ids = batch.column(0).take(pa.array(np.repeat(rows, counts)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), ids], ["token", "doc_id"])

    return run


def _pair_keys(cell_bits: int, level: int, often: np.ndarray, missing: int) -> np.ndarray:
    """Pairs of frequent tokens in one cell, of the shortest run of tokens that makes up for ``missing`` rare ones."""
    cell = often >> np.uint64(64 - cell_bits) if cell_bits else np.zeros(len(often), dtype=np.uint64)
    later = np.zeros(len(often), dtype=np.int64)
    later[1:] = cell[1:] == cell[:-1]
    enough = np.searchsorted(np.cumsum(later), missing) + 1
    often, cell = often[:enough], cell[:enough]
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    out = []
    with np.errstate(over="ignore"):
        for a, b in zip(starts, [*starts[1:], len(often)], strict=True):
            i, j = np.triu_indices(b - a, 1)
            out.append(mix(often[a + i] * np.uint64(3) + mix(often[a + j]) + np.uint64(level)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def pair_signature(n: int, often: np.ndarray, share: int) -> np.ndarray:
    """Index keys of a set of n tokens of which those in ``often`` (sorted) are frequent and too few are rare.
    Cells depend on the size of the sets; a set near a boundary is indexed for the sizes on both sides."""
    missing = prefix_need(n, share) - (n - len(often))
    if missing <= 0 or not len(often):
        return np.empty(0, np.uint64)
    low, high = ((share * n + 99) // 100).bit_length() - 1, (n * 100 // share).bit_length() - 1
    return np.concatenate([_pair_keys(max(0, level - 2), level, often, missing) for level in range(low, high + 1)])


def _paired(share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for k, (n, often) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                own = pair_signature(n, np.sort(often.values.to_numpy(zero_copy_only=False).view(np.uint64)), share)
                keys.append(own)
                rows.append(np.full(len(own), k))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), batch.column(0).take(pa.array(np.concatenate(rows)))], ["key", "doc_id"])

    return run


def _whole(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sets = [], []
            for k, tokens in _sets(batch.column(1), size):
                rows.append(k)
                sets.append(tokens.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sets, pa.binary())], ["doc_id", "tokens"])

    return run


def _similar(share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= share * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (0, 1)], ["a", "b"])

    return run


def _across(share: int):
    """Similar pairs of different components between two blocks of sets."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(left) and len(right):
            sides = []
            for rows in (left, right):
                sets = [np.sort(np.asarray(t, dtype=np.int64).view(np.uint64)) for t in rows["tokens"]]
                sides.append((rows["doc_id"].tolist(), rows["c"].to_numpy(), sets, np.array([len(t) for t in sets]), np.array([odd_sketch(t) for t in sets])))
            (ids, c, x, n, bits), (other_ids, other_c, y, m, other_bits) = sides
            main = left["main"].iloc[0]
            for k in range(len(ids)):
                total = n[k] + m
                least = (share * total + 99 + share) // (100 + share)
                # of two that are both outside the main component the smaller id asks
                near = (other_c != c[k]) & ((other_c == main) | (np.array(other_ids) > ids[k])) & (least <= np.minimum(n[k], m))
                near[near] &= np.bitwise_count(other_bits[near] ^ bits[k]).sum(axis=1) <= total[near] - 2 * least[near]
                for j in np.flatnonzero(near).tolist():
                    if total[j] - len(np.union1d(x[k], y[j])) >= least[j]:
                        found.append((min(ids[k], other_ids[j]), max(ids[k], other_ids[j])))
        return pd.DataFrame(found, columns=["a", "b"])

    return run


class _Join:
    """One run: the tables that its steps share."""

    def __init__(self, docs: DataFrame, size: int, share: int, rare: int, block_docs: int):
        self.size, self.share, self.rare, self.block_docs = size, share, rare, block_docs
        self.id_type = docs.schema["doc_id"].dataType.simpleString()
        docs = docs.select("doc_id", "text")
        self.texts = docs.where("doc_id is not null and text is not null")
        sketch = ", ".join(f"{c} long" for c in _SKETCH)
        self.profile = durable(docs.mapInArrow(_profile(size), f"doc_id {self.id_type}, n int, d1 long, d2 long, {sketch}"))
        self.sets = durable(
            self.profile.where("n > 0 and doc_id is not null").groupBy("n", "d1", "d2")
            .agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in _SKETCH))
        )
        self.kept = [self.sets]

    def keep(self, df: DataFrame) -> DataFrame:
        """A durable table that is released with the run."""
        self.kept.append(durable(df))
        return self.kept[-1]

    # what two similar sets must have in common
    def overlap(self, m: Column, n: Column) -> Column:
        return _div(self.share * (m + n) + 99 + self.share, 100 + self.share)

    def close(self, a: str, b: str) -> Column:
        """Sizes and sketches of sides named a and b allow similarity."""
        m, n = F.col(f"{a}.n"), F.col(f"{b}.n")
        differ = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in _SKETCH[1:]), F.bit_count(F.col(f"{a}.o0").bitwiseXOR(F.col(f"{b}.o0"))))
        least = self.overlap(m, n)
        return (least <= F.least(m, n)) & (differ <= m + n - 2 * least)

    def refined(self, pairs: DataFrame, info: DataFrame, enough: Column | None = None) -> DataFrame:
        """Pairs a, b (and more columns) that sizes, sketches and ``enough`` do not refute."""
        rows = pairs.alias("p").join(info.alias("x"), F.col("p.a") == F.col("x.doc_id")).join(info.alias("y"), F.col("p.b") == F.col("y.doc_id"))
        return rows.where(self.close("x", "y") if enough is None else self.close("x", "y") & enough).select("p.a", "p.b")

    def first_prefixes(self) -> tuple[DataFrame, DataFrame]:
        """Step 1: candidates by rare single tokens, and the hard sets."""
        prefixes = self.texts.mapInArrow(_tokens(self.size, self.share, False), f"token long, doc_id {self.id_type}")
        classes = prefixes.groupBy("token").agg(F.count("*").alias("docs")).where("docs > 1").select("token", (F.col("docs") > self.rare).alias("frequent"))
        # copies are known by their representative alone
        shared = self.keep(prefixes.join(classes, "token").join(self.sets.select("doc_id"), "doc_id", "left_semi"))
        frequent = shared.where("frequent").groupBy("doc_id").agg(F.count("*").cast("int").alias("f"))
        n = F.col("n")
        spare = lambda m: prefix_length(m, self.share) - prefix_need(m, self.share) + 1
        info = self.sets.join(frequent, "doc_id", "left").withColumn("f", F.coalesce("f", F.lit(0)))
        info = self.keep(info.select("doc_id", "n", "copies", "f", *_SKETCH, (F.col("f") >= spare(_div(self.share * n + 99, 100))).alias("hard")))
        pairs = self._pairs(shared.where("not frequent").select("token", "doc_id")).groupBy("a", "b").agg(F.count("*").alias("common"))
        m, k = F.col("x.n"), F.col("y.n")
        least = self.overlap(m, k)
        alike = F.least(*(prefix_length(c, self.share) - (c - least) for c in (m, k)))
        return self.refined(pairs, info, F.col("p.common") >= alike - F.least("x.f", "y.f")), info

    def _pairs(self, keys: DataFrame) -> DataFrame:
        """Rows of token, doc_id as pairs a < b; a token has at most ``rare`` rows."""
        return keys.select("token", F.col("doc_id").alias("a")).join(keys.select("token", F.col("doc_id").alias("b")), "token").where("a < b").select("a", "b")

    def hard_sets(self, info: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Step 2: candidates by rare single tokens of the hard sets; the sets that still lack rare ones, with their frequent tokens."""
        hard = info.where("hard")
        texts = self.texts.join(sent_if_small(self.keep(hard.select("doc_id"))), "doc_id", "left_semi").select("doc_id", "text")
        tokens = self.keep(texts.mapInArrow(_tokens(self.size, self.share, True), f"token long, doc_id {self.id_type}").distinct())
        often = sent_if_small(self.keep(tokens.groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > self.rare).select("token", F.lit(True).alias("frequent"))))
        split = lambda which: F.sort_array(F.collect_list(F.when(which, F.col("token"))))
        own = self.keep(
            tokens.join(often, "token", "left").groupBy("doc_id").agg(split(F.col("frequent").isNull()).alias("single"), split(F.col("frequent")).alias("often"))
            .join(hard.select("doc_id", "n"), "doc_id")
        )
        need = prefix_need(F.col("n"), self.share)
        keys = own.select(F.explode(F.slice("single", F.lit(1), need)).alias("token"), "doc_id")
        lacking = own.where(F.size("single") < need).select("doc_id", "n", "often", F.concat("single", "often").alias("tokens"))
        return self.refined(self._pairs(keys).distinct(), hard), lacking

    def buckets(self, lacking: DataFrame, info: DataFrame) -> DataFrame:
        """Step 3: each member of a bucket of frequent pairs with the bucket's two leaders."""
        keys = self.keep(lacking.mapInArrow(_paired(self.share), f"key long, doc_id {self.id_type}").distinct())
        # the likely centre of a group of near copies: the set with most copies; and any one, the same in all buckets
        centre = F.struct("copies", F.xxhash64("doc_id").alias("r"), "doc_id")
        leaders = (
            keys.join(info.select("doc_id", "copies"), "doc_id").groupBy("key")
            .agg(F.max(centre).alias("l1"), F.min(F.struct(F.xxhash64("doc_id").alias("r"), "doc_id")).alias("l2"), F.count("*").alias("c"))
            .where("c > 1").select("key", F.explode(F.array_distinct(F.array("l1.doc_id", "l2.doc_id"))).alias("l"))
        )
        led = keys.join(leaders, "key").where(F.col("doc_id") != F.col("l"))
        return self.keep(led.select(F.least("doc_id", "l").alias("a"), F.greatest("doc_id", "l").alias("b")).distinct())

    def apart(self, lacking: DataFrame, clusters: DataFrame, found: DataFrame) -> DataFrame:
        """Links between members of one cluster in different components.  Members of a cluster's largest component are compared
        with the others only.  Both sides are dealt in blocks of bounded size; every pair of blocks is one group."""
        own = (
            lacking.select("doc_id", "n").join(clusters.select(F.col("id").alias("doc_id"), F.col("component").alias("cluster")), "doc_id")
            .join(found.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id"))
        )
        parts = own.groupBy("cluster", "c").agg(F.count("*").alias("k"), F.sum("n").alias("tokens")).groupBy("cluster").agg(
            F.count("*").alias("parts"), F.max(F.struct("k", "c", "tokens")).alias("m"), F.sum("k").alias("k"), F.sum("tokens").alias("tokens")
        )
        blocks = lambda docs, tokens: F.ceil(F.greatest(docs / self.block_docs, tokens / (500 * self.block_docs), F.lit(1))).cast("int")
        parts = parts.where("parts > 1").select(
            "cluster", F.col("m.c").alias("main"), blocks(F.col("k") - F.col("m.k"), F.col("tokens") - F.col("m.tokens")).alias("left"), blocks(F.col("k"), F.col("tokens")).alias("right")
        )
        member = self.keep(own.join(parts, "cluster").join(lacking.select("doc_id", "tokens"), "doc_id").select("cluster", "doc_id", "c", "main", "left", "right", "tokens"))
        deal = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        columns = ["cluster", "i", "j", "doc_id", "c", "main", "tokens"]
        minor = member.where("c <> main").withColumn("i", deal("left")).withColumn("j", every("right")).select(*columns)
        other = member.withColumn("j", deal("right")).withColumn("i", every("left")).select(*columns)
        kind = f"a {self.id_type}, b {self.id_type}"
        return minor.groupBy("cluster", "i", "j").cogroup(other.groupBy("cluster", "i", "j")).applyInPandas(_across(self.share), kind)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are similar, by their whole sets."""
        wanted = sent_if_small(self.keep(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()))
        sets = self.texts.join(wanted, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_whole(self.size), f"doc_id {self.id_type}, tokens binary")
        own = lambda k: sets.select(F.col("doc_id").alias(k), F.col("tokens").alias(f"t{k}"))
        return pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", "ta", "tb").mapInArrow(_similar(self.share), f"a {self.id_type}, b {self.id_type}")

    def run(self) -> DataFrame:
        """id, component of the representatives that have links."""
        first, info = self.first_prefixes()
        candidates = [first]
        lacking = star = None
        if info.where("hard").limit(1).count():
            second, lacking = self.hard_sets(info)
            lacking = self.keep(lacking)
            star = self.buckets(lacking, info)
            candidates += [second, self.refined(star, info)]
        every = candidates[0]
        for more in candidates[1:]:
            every = every.unionByName(more)
        tested = self.keep(every.distinct())
        links = self.keep(self.verified(tested))
        found = components(links)
        if star is not None:
            clusters = self.keep(components(star))
            rest = self.keep(self.apart(lacking, clusters, found))
            if rest.limit(1).count():
                found = components(links.unionByName(rest))
        return found


def near_duplicates(docs: DataFrame, *, size: int = 5, share: int = 80, rare: int = 16, block_docs: int = 400) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links of
    Jaccard similarity >= share / 100, itself included)."""
    join = _Join(docs, size, share, rare, block_docs)
    found = join.run()
    named = durable(join.sets.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("n", "d1", "d2", F.coalesce("component", "doc_id").alias("component_id")))
    release(*join.kept)
    return join.profile.join(named, ["n", "d1", "d2"], "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def one_of_each_group(docs: DataFrame, *, size: int = 5, share: int = 80, **options) -> DataFrame:
    """The documents, with all their columns, that are the smallest doc_id of their component; one row of a
    repeated doc_id.  Documents without words or without an id stay."""
    found = durable(near_duplicates(docs, size=size, share=share, **options))
    gone = sent_if_small(durable(found.where("doc_id <> component_id").select("doc_id").distinct()))
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = durable(found.where("doc_id is not null").groupBy("doc_id").count().where(F.col("count") > 1).select("doc_id"))
    if not twice.limit(1).count():
        return kept
    twice = sent_if_small(twice)
    once = kept.join(twice, "doc_id", "left_anti").select(*docs.columns)
    return once.unionByName(kept.join(twice, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))
