"""Packing documents into sequences of a fixed number of tokens.

Each document's ids are cut into whole sequences and one rest.  The pieces (a few
numbers each, never the ids) are dealt at random into groups of about
``group_size``; within a group they are placed first-fit decreasing, the first bin
with room found by a tournament tree over the bins' free capacities.  Groups are
independent tasks, so a group never grows with the corpus, and the last, half-empty
bins cost one part in ``group_size``.

Tokenising splits a text into the tokenizer's own pre-tokens with numpy, looks each
distinct one up in a bounded cache and lets the tokenizer encode only those it has
not met.  Texts with characters beyond U+024F or with a special token's string go
through the tokenizer whole.

Null text is empty: its only id is the end id.  Repeated rows are packed as often as
they occur; equal lengths are placed in the order of doc_id and start.  An empty
table gives an empty result.  Only doc_id and text are read, so extra columns cannot
clash.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilquery.llm._common import durable, mix, powers

_PLAIN = 0x250
_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
_CACHE_WORDS = 300_000  # known at once; some 50 MB
_FAST_BITS = 17


class Encoder:
    """Ids of texts by a byte-level BPE tokenizer file whose pre-tokenizer is the usual
    contractions / letters / numbers / other / white space pattern."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = [chr(i) for i in range(_PLAIN)]
        self.kind = np.array(
            [_LETTER if regex.match(r"\p{L}", c) else _NUMBER if regex.match(r"\p{N}", c) else _SPACE if regex.match(r"\s", c) else _OTHER for c in plain],
            dtype=np.uint8,
        )
        self.value = mix(np.arange(1, _PLAIN + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
        # byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        shown = {b: b for b in printable}
        shown |= {b: 0x100 + k for k, b in enumerate(x for x in range(256) if x not in shown)}
        self.alphabet = "".join(chr(shown[b]) for b in range(256))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.used = np.empty(1 << 20, dtype=np.uint32), 0
        self.at, self.size = np.empty(1 << 16, dtype=np.int64), np.empty(1 << 16, dtype=np.int64)
        # the latest word of each slot, so that frequent words need no sort
        self.fast_hash = np.zeros(1 << _FAST_BITS, dtype=np.uint64)
        self.fast_entry = np.zeros(1 << _FAST_BITS, dtype=np.int64)

    def _learn(self, hashes: list[int], words: list[str]) -> None:
        tokenize, alphabet = self.tokenizer.model.tokenize, self.alphabet
        for h, word in zip(hashes, words, strict=True):
            ids = [t.id for t in tokenize(word.encode().decode("latin-1").translate(alphabet))]
            k = len(self.known)
            if k == len(self.at):
                self.at, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.at, self.size))
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty(max(len(self.flat), len(ids)), dtype=np.uint32)])
            self.flat[self.used : self.used + len(ids)] = ids
            self.at[k], self.size[k] = self.used, len(ids)
            self.used += len(ids)
            self.known[h] = k

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        group: list[int] = []
        chars = 0
        for i, t in enumerate(texts):
            t = t or ""
            if (t.isascii() or max(t) < chr(_PLAIN)) and not any(s in t for s in self.special):
                group.append(i)
                chars += len(t)
                if chars > 1 << 18:
                    self._encode_plain(texts, group, out)
                    group, chars = [], 0
            else:
                out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype=np.uint32)
        if group:
            self._encode_plain(texts, group, out)
        return out

    def _encode_plain(self, texts: list[str | None], rows: list[int], out: list[np.ndarray | None]) -> None:
        joined = "".join(texts[i] or "" for i in rows)
        bounds = np.concatenate([[0], np.cumsum([len(texts[i] or "") for i in rows])])
        n = len(joined)
        if not n:
            for i in rows:
                out[i] = np.empty(0, dtype=np.uint32)
            return
        if len(self.known) > _CACHE_WORDS:
            self._forget()
        code = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        first = np.zeros(n + 1, dtype=bool)
        first[bounds] = True
        starts = np.flatnonzero(self._starts(code, first))
        up, down = powers(n + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(self.value[code] * up[:n], out=total[1:])
            ends = np.append(starts[1:], n)
            hashes = mix((total[ends] - total[starts]) * down[starts])
        slot = (hashes >> np.uint64(64 - _FAST_BITS)).astype(np.int64)
        entry = self.fast_entry[slot]
        missed = np.flatnonzero(self.fast_hash[slot] != hashes)
        if len(missed):
            distinct, sample, which = np.unique(hashes[missed], return_index=True, return_inverse=True)
            keys = distinct.tolist()
            new = [j for j, h in enumerate(keys) if h not in self.known]
            if new:
                at = missed[sample[new]].tolist()
                self._learn([keys[j] for j in new], [joined[starts[s] : ends[s]] for s in at])
            found = np.array([self.known[h] for h in keys], dtype=np.int64)
            entry[missed] = found[which]
            slot = (distinct >> np.uint64(64 - _FAST_BITS)).astype(np.int64)
            self.fast_hash[slot], self.fast_entry[slot] = distinct, found
        size = self.size[entry]
        end = np.cumsum(size)
        ids = self.flat[np.repeat(self.at[entry] - (end - size), size) + np.arange(end[-1])]
        token_first = np.concatenate([[0], end])[np.searchsorted(starts, bounds)]
        for k, i in enumerate(rows):
            out[i] = ids[token_first[k] : token_first[k + 1]]

    def _starts(self, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin.  first[i]: a text begins at i (or ends at the array's end)."""
        n = len(code)
        kind = self.kind[code]
        space = kind == _SPACE
        start = np.ones(n, dtype=bool)
        start[1:] = kind[1:] != kind[:-1]
        # a blank goes with the word after it; of other white space before a word only the last stands alone
        blank_before = np.zeros(n, dtype=bool)
        blank_before[1:] = (code[:-1] == 0x20) & ~first[1:n]
        start &= ~blank_before | space
        last_of_run = np.zeros(n, dtype=bool)
        last_of_run[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
        start |= last_of_run
        start |= first[:n]
        quote = np.flatnonzero((code == 0x27) & start)
        if len(quote):
            padded = np.append(code, [0, 0, 0])
            ends_text = np.append(first, [True, True])
            a, b = padded[quote + 1], padded[quote + 2]
            one = np.isin(a, [0x73, 0x74, 0x6D, 0x64]) & ~ends_text[quote + 1]
            two = ((a == 0x72) & (b == 0x65) | (a == 0x76) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)) & ~ends_text[quote + 1] & ~ends_text[quote + 2]
            for which, length in ((one, 2), (two, 3)):
                at = quote[which]
                for k in range(1, length):
                    start[at + k] = False
                after = at + length
                start[after[after < n]] = True
        return start


def _pieces(path: str, end_id: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            ids_of, texts = batch.column(0), batch.column(1)
            rows: tuple[list, ...] = ([], [], [], [], [])
            source = []
            for a in range(0, len(texts), 256):
                for k, ids in enumerate(encoder.encode(texts.slice(a, 256).to_pylist()), start=a):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for s in range(0, len(ids), length):
                        part = ids[s : s + length]
                        source.append(k)
                        for column, v in zip(rows, (s, len(part), zlib.crc32(part.tobytes()), len(ids)), strict=False):
                            column.append(v)
            columns = [ids_of.take(pa.array(source, pa.int64())), *(pa.array(c, pa.int64()) for c in rows[:4])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (given in decreasing order, none over the capacity).

    The tree's leaves are the bins' free capacities and each inner node is the larger
    of its children, so the first bin with room is found on one way down."""
    n = len(lengths)
    leaves = 1 << max(0, math.ceil(math.log2(max(1, n))))
    free = [capacity] * (2 * leaves)
    bins, offsets = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for i, need in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - free[node]
        free[node] -= need
        node //= 2
        while node:
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
            node //= 2
    return bins, offsets


def _place(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=rows["_group"].to_numpy() * (1 << 32) + bins, offset=offsets).drop(columns="_group")

    return run


def pack(
    docs: DataFrame, tokenizer_path: str, *, end_id: int = 1, length: int = 2048, group_size: int = 8192, seed: int = 20
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long"
    # kept, as the number of groups depends on it and the texts should be tokenised once
    pieces = durable(docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer_path, end_id, length), schema))
    groups = max(1, round(pieces.count() / group_size))
    dealt = pieces.withColumn("_group", F.floor(F.rand(seed) * groups).cast("long"))
    return dealt.groupBy("_group").applyInPandas(_place(length), schema + ", sequence_id long, offset long")
