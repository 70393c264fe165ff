"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilquery.llm import decontamination, jaccard_join, line_dedup, packing, substring_dedup

KIND = "doc_id long, text string, source string, n_words string, key int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed=1, n=60):
    r = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(900)] + ["É", "ünï", "X-y"]
    texts = [" ".join(r.choice(words, r.integers(1, 160))) for _ in range(n)]
    shared = " ".join(r.choice(words, 70))
    for i in range(0, n, 4):  # near copies, copies, a shared passage and a line of many sites
        t = texts[i].split()
        t[len(t) // 2] = "edited"
        texts[i + 1] = " ".join(t)
        texts[i + 2] = texts[i + 2] + "\nall rights reserved \n" + shared + " tail"
    texts += [None, "", "  \t ", "One", "one", " ".join(r.choice(words, 9000)), texts[3], texts[3].upper()]
    rows = [(i, t, f"s{i % 13}", "clash", 7) for i, t in enumerate(texts)]
    return [*rows, rows[2], (None, texts[0], None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), KIND).repartition(3)


def spaced(t):
    return [w.decode() for w in (t or "").encode().split()]


def test_substring_dedup(docs):
    rows = corpus()
    starts = collections.defaultdict(set)
    for i, t, *_ in rows:
        w = spaced(t)
        for k in range(len(w) - 49):
            if i is not None:
                starts[tuple(w[k : k + 50])].add(i)
    want = collections.Counter()
    for i, t, *_ in rows:
        w, gone = spaced(t), set()
        for k in range(len(w) - 49):
            if i is not None and min(starts[tuple(w[k : k + 50])]) < i:
                gone |= set(range(k, k + 50))
        want[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    for options in ({}, {"split_passages": 1, "shard_words": 500}):
        got = substring_dedup.remove_repeats(docs, **options).collect()
        assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == want


def near_copies(n=90):
    """A large group whose members differ from each other by more or less than the bound, around one text with copies."""
    r = np.random.default_rng(8)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(n):
        words = list(base)
        for k in r.choice(len(words), r.integers(0, 5), replace=False):
            words[k] = f"x{r.integers(40)}"
        rows.append((1000 + i, " ".join(words), "s", "clash", 7))
    return rows


@pytest.mark.parametrize(("size", "share", "options"), [(4, 85, {}), (2, 60, {"rare": 3}), (5, 80, {"rare": 1}), (4, 85, {"rare": 4, "block_docs": 20})])
def test_jaccard_join(spark, size, share, options):
    rows = corpus() + near_copies()
    docs = spark.createDataFrame(rows, KIND).repartition(3)
    sets = {}
    for i, t, *_ in rows:
        w = spaced((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = jaccard_join.near_duplicates(docs, size=size, share=share, **options).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id]) and r.component_id == (None if r.doc_id is None else find(r.doc_id))
    kept = jaccard_join.one_of_each_group(docs, size=size, share=share, **options)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(i for i in ids if find(i) == i)


def test_pair_keys_cover_similar_sets():
    r = np.random.default_rng(4)
    for _ in range(300):
        n = int(r.integers(4, 120))
        x = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        drop = int(r.integers(0, max(1, len(x) // 7)))
        y = np.unique(np.concatenate([x[r.permutation(len(x))[drop:]], r.integers(0, 1 << 63, drop).astype(np.uint64)]))
        if 100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y)):
            hot = np.sort(r.permutation(np.union1d(x, y))[: int(r.integers(0, len(x) + 1))])
            often = [np.intersect1d(s, hot) for s in (x, y)]
            lacking = [len(s) - len(o) < jaccard_join.prefix_need(len(s), 85) for s, o in zip((x, y), often, strict=True)]
            rare = [np.setdiff1d(s, hot)[: jaccard_join.prefix_need(len(s), 85)] for s in (x, y)]
            found = len(np.intersect1d(*rare)) > 0
            if all(lacking):
                found |= len(np.intersect1d(*(jaccard_join.pair_signature(len(s), o, 85) for s, o in zip((x, y), often, strict=True)))) > 0
            assert found


def test_odd_sketches_never_exceed_the_difference():
    r = np.random.default_rng(5)
    for _ in range(200):
        both, one, two = (r.integers(0, 1 << 63, r.integers(0, 400)).astype(np.uint64) for _ in range(3))
        x, y = np.unique(np.concatenate([both, one])), np.unique(np.concatenate([both, two]))
        bits = sum(int(a ^ b).bit_count() for a, b in zip(*(jaccard_join.odd_sketch(s).view(np.uint64).tolist() for s in (x, y)), strict=True))
        assert bits <= len(np.setxor1d(x, y))


def test_decontamination(spark, docs):
    rows = corpus()
    texts = [t for _, t, *_ in rows]
    items = [(1, " ".join(spaced(texts[5])[10:40]).upper() + "!"), (12, texts[9]), (3, "One"), (4, None), (5, ""), (12, texts[9]), (6, "nowhere to be found in any of these texts at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = word.findall((t or "").translate(LOWER))
        m = min(10, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[k : k + m])].add(str(i))
    want = collections.Counter()
    for i, t, *_ in rows:
        w, hit, found = word.findall((t or "").translate(LOWER)), set(), set()
        for m in {len(k) for k in windows}:
            for k in range(len(w) - m + 1):
                if own := windows.get(tuple(w[k : k + m])):
                    hit |= set(range(k, k + m))
                    found |= own
        want[i, len(w), len(hit), tuple(sorted(found))] += 1
    for options in ({}, {"block_bytes": 400}):
        got = decontamination.contamination(docs, bench, **options).collect()
        assert collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == want
    kept = decontamination.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in want.items() if not k[2])


def test_longest_matches_and_clashing_names(spark):
    item = [f"b{i % 23}" for i in range(60)]
    texts = [" ".join(["x", *item[5:40], "y", *item[:12]]), " ".join(item), "b0 b1", None, ""]
    docs = spark.createDataFrame([(i, t, "kept", 9) for i, t in enumerate(texts)], "doc_id long, text string, _words string, _FOUND int")
    bench = spark.createDataFrame([("i", " ".join(item))], "item_id string, text string")
    got = {r.doc_id: r for r in decontamination.contamination(docs, bench).collect()}
    assert (got[0].longest.start, got[0].longest.length, got[1].longest.length) == (1, 35, 60)
    assert (got[0].n_hit, got[1].n_hit, got[2].n_hit, got[3].n_words, got[4].n_hit) == (47, 60, 0, 0, 0)
    kept = decontamination.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} == {(2, "b0 b1", "kept", 9), (3, None, "kept", 9), (4, "", "kept", 9)}


def test_line_dedup(docs):
    rows = corpus()
    sites = collections.defaultdict(set)
    for _, t, s, *_ in rows:
        for line in (t or "").split("\n"):
            sites[line.strip(" \t")].add(s)
    out = line_dedup.remove_boilerplate(docs, min_sites=4)
    assert set(docs.columns) <= set(out.columns)
    want = collections.Counter()
    for i, t, *_ in rows:
        lines = t.split("\n") if t else []
        kept = [x for x in lines if not x.strip(" \t") or len(sites[x.strip(" \t")]) < 4]
        want[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    assert collections.Counter((r.doc_id, r._ld_lines, r._ld_removed, r.text) for r in out.collect()) == want
    assert any(k[2] for k in want)


def test_packing_round_trip(docs):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs, tokenizers.path("byte_bpe_50k.json"), length=256, group_size=40).toPandas()
    for i, t, *_ in corpus():
        ids = own.encode(t or "", add_special_tokens=False).ids + [1]
        part = got[got.doc_id == i] if i is not None else got[got.doc_id.isna()]
        assert set(zip(part.start, part.length, part.ids_crc32, part.doc_tokens, strict=True)) == {
            (s, len(ids[s : s + 256]), zlib.crc32(np.array(ids[s : s + 256], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 256)
        }
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert list(part.offset) == list(np.cumsum([0, *part.length])[:-1]) and part.length.sum() <= 256


def test_encoder_matches_the_tokenizer():
    tokenizers = pytest.importorskip("public_tokenizers")
    encoder = packing.Encoder(tokenizers.path("byte_bpe_50k.json"))
    texts = ["it's we'll \n\n x  y\t\tz ", "a<|endoftext|>b", "É ünï 12² «x»", "日本 語 😀", None, "", " ", "'s\n's 's", "  x \u0085"]
    for t, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == encoder.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_first_fit_decreasing_is_first_fit():
    sizes = np.sort(np.random.default_rng(2).integers(1, 100, 300))[::-1]
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    free = []
    for n, b, o in zip(sizes, bins, offsets, strict=True):
        k = next((k for k, f in enumerate(free) if f >= n), len(free))
        if k == len(free):
            free.append(100)
        assert (b, o) == (k, 100 - free[k])
        free[k] -= n


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert substring_dedup.remove_repeats(none).count() == 0
    assert jaccard_join.near_duplicates(none).count() == 0
    assert decontamination.contamination(docs, bench).where("n_hit > 0").count() == 0
    assert line_dedup.remove_boilerplate(none).count() == 0
    tokenizers = pytest.importorskip("public_tokenizers")
    assert packing.pack(none, tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert hashlib.sha256(b"").hexdigest() == decontamination.contamination(docs, bench).select(F.sha2(F.array_join("items", ","), 256)).first()[0]
