"""Benchmark decontamination by q-gram lemma filtering.

Texts and items are compared as words (ASCII letters, digits, non-ASCII
characters; case folded) with one space between them. An item of m characters
occurs in a text when some part of the text is within
``k = min(floor(rate * m), (m - q) // q)`` edits of it.

By the q-gram lemma such a part shares at least ``m - q + 1 - k * q`` character
q-grams with the item, on ``k + 1`` adjacent diagonals (position in the text less
position in the item). Diagonals are cut into bands of ``2 * (k + 1)`` which
overlap by half, so that one band holds all of them. Shared q-grams are counted
by band; regions that meet the bound are kept and verified by an alignment
within the band.

All of each text is compared with all items. Items go to the tasks in shards of
``SHARD_CHARS`` characters (a longer item is a shard of its own), each broadcast by
itself; the driver reads them one at a time and holds no more than one. A task holds the
index of ``PASS_SHARDS`` of them at most: a larger benchmark takes more passes over the
texts, and each text is held against every shard.

Defined results:

* a null or empty text, or one without words, has no matches; a null document key is
  reported as any other; very long texts are read whole;
* items that are null or shorter than q characters are ignored; repeated item
  ids or texts are items of their own; an item with a null id is ignored;
* of overlapping matches of one item in one text the one with the fewest edits
  stays, then the leftmost; a match's end is the earliest with its edits, its start the
  leftmost that goes with that end;
* repeated rows each get their matches, in no order; an empty benchmark or table gives
  none; other columns are not read, whatever their names (``clean`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsieve.llm.textops import U64, WORD_BYTE, buffers, char_index, fold, lists, slices

Q = 10
RATE = 0.08
SHARD_CHARS, PASS_SHARDS = 4_000_000, 8
MATCHES = "array<struct<item:bigint,start:int,end:int,edits:int>>"
MATCH = pa.struct([("item", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())])
_BIG = 1 << 40


def normal(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, source position of each byte) of the normal form of each row."""
    if not len(data):
        return data, offsets, np.zeros(0, np.int64)
    word = WORD_BYTE[data]
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first byte after a word is its space
    starts = offsets[:-1][(offsets[:-1] < len(data))]
    keep[starts] = word[starts]
    at = np.flatnonzero(keep)
    return np.where(word[at], fold(data)[at], 32).astype(np.uint8), np.searchsorted(at, offsets), at


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q bytes from each position (8 <= q <= 16), for len(data) - q + 1 positions."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, U64)
    two = data[:-1].astype(U64) | (data[1:].astype(U64) << U64(8))
    four = two[:-2] | (two[2:] << U64(16))
    eight = four[:-4] | (four[4:] << U64(32))
    out = eight[:n] * U64(0x9E3779B97F4A7C15)
    if q > 8:
        out ^= out >> U64(32)
        out += eight[q - 8 : q - 8 + n]
        out *= U64(0xD6E8FEB86659FD93)
    return out ^ (out >> U64(29))


def budget(m: int, q: int, rate: float) -> int:
    return max(0, min(int(rate * m), (m - q) // q))


class Index:
    """The q-grams of a shard of items."""

    def __init__(self, ids: list[int], texts: list[str], q: int, rate: float):
        data, offsets, _ = normal(*buffers(pa.array(texts, pa.string())))
        sizes = np.diff(offsets)
        trailing = (sizes > 0) & (data[np.maximum(offsets[1:] - 1, 0)] == 32) if len(data) else sizes > 0
        items = [data[s : s + n] for s, n in zip(offsets[:-1], sizes - trailing, strict=True)]
        on = [i for i, x in enumerate(items) if len(x) >= q]
        self.q, self.items, self.ids = q, [items[i] for i in on], np.array([ids[i] for i in on], np.int64)
        self.m = np.array([len(x) for x in self.items], np.int64)
        self.k = np.array([budget(int(m), q, rate) for m in self.m], np.int64)
        self.least = self.m - q + 1 - self.k * q
        if not on:
            return
        hashed = [grams(x, q) for x in self.items]
        gram, item = np.concatenate(hashed), np.repeat(np.arange(len(on)), [len(x) for x in hashed])
        place = np.concatenate([np.arange(len(x)) for x in hashed])
        order = np.argsort(gram, kind="stable")
        self.item, self.place = item[order], place[order]
        self.gram, self.first, self.count = np.unique(gram[order], return_index=True, return_counts=True)
        bits = max(20, int(np.ceil(np.log2(len(self.gram) * 24))))
        self.shift = U64(64 - bits)
        self.known = np.zeros(1 << bits, dtype=bool)
        self.known[self.gram >> self.shift] = True

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, first diagonal of the band) of the regions that meet the bound."""
        none = (np.zeros(0, np.int64),) * 3
        g = grams(data, self.q)
        at = np.flatnonzero(self.known[g >> self.shift])
        found = np.searchsorted(self.gram, g[at])
        found[found == len(self.gram)] = 0
        ok = self.gram[found] == g[at]
        at, found = at[ok], found[ok]
        row = np.searchsorted(offsets, at, side="right") - 1
        ok = at + self.q <= offsets[row + 1]
        at, found, row = at[ok], found[ok], row[ok]
        if not len(at):
            return none
        times = self.count[found]
        entry = np.repeat(self.first[found] - np.cumsum(times) + times, times) + np.arange(times.sum())
        item, row = self.item[entry], np.repeat(row, times)
        diagonal = np.repeat(at, times) - self.place[entry] + int(self.m.max())  # never negative
        band = diagonal // (self.k[item] + 1)
        high = int(band.max()) + 2
        key = np.concatenate([((row * len(self.m) + item) * high + band + 1 - half) for half in (0, 1)])
        key, n = np.unique(key, return_counts=True)
        item = key // high % len(self.m)
        ok = n >= self.least[item]
        key, item = key[ok], item[ok]
        return key // high // len(self.m), item, (key % high - 1) * (self.k[item] + 1) - int(self.m.max())

    def verify(self, data: np.ndarray, offsets: np.ndarray, row: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, item, start, end, edits) of the candidates within their budgets; positions in data."""
        m, k = self.m[item], self.k[item]
        low = diagonal - k  # the band, and what an alignment may leave it by
        width = int((2 * (k + 1) + 2 * k).max()) + 1
        lo, hi = offsets[row], offsets[row + 1]
        d = np.arange(width)
        pattern = np.zeros((len(row), int(m.max())), np.uint8)
        for i, x in enumerate(item):
            pattern[i, : m[i]] = self.items[x]
        unit = np.int64(1) << 20
        start = low[:, None] + d
        value = np.where((start >= lo[:, None]) & (start <= hi[:, None]), d[None, :], _BIG)
        ramp = d * unit
        best, end = np.full(len(row), _BIG), np.zeros(len(row), np.int64)
        for i in range(int(m.max())):
            pos = low[:, None] + d + i  # the text position that the diagonal step consumes
            inside = (pos >= lo[:, None]) & (pos < hi[:, None])
            same = data[np.clip(pos, 0, max(0, len(data) - 1))] == pattern[:, i : i + 1]
            step = np.where(inside, value + np.where(same, 0, unit), _BIG)
            drop = np.full_like(value, _BIG)
            drop[:, :-1] = value[:, 1:] + unit
            drop[pos + 1 > hi[:, None]] = _BIG  # ends beyond the row
            new = np.minimum(step, drop)
            new = np.minimum.accumulate(new - ramp, axis=1) + ramp
            new[(pos + 1 > hi[:, None]) | (pos + 1 < lo[:, None])] = _BIG
            value = np.minimum(new, _BIG)
            done = np.flatnonzero(m == i + 1)
            if len(done):
                # fewest edits, then the shortest end
                c = (value[done] // unit).argmin(1)
                best[done] = value[done, c]
                end[done] = low[done] + c + i + 1
        edits = best // unit
        ok = (edits <= k) & (best < _BIG)
        return row[ok], item[ok], (low + best % unit)[ok], end[ok], edits[ok]

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, item, start, end, edits), positions in bytes of the normal form, merged and in order."""
        if not len(self.items) or len(data) < self.q:
            return (np.zeros(0, np.int64),) * 5
        row, item, diagonal = self.candidates(data, offsets)
        found = [self.verify(data, offsets, row[i : i + 512], item[i : i + 512], diagonal[i : i + 512]) for i in range(0, len(row), 512)]
        if not found:
            return (np.zeros(0, np.int64),) * 5
        row, item, start, end, edits = (np.concatenate(x) for x in zip(*found, strict=True))
        keep, taken = [], {}
        for i in np.lexsort((start, edits, item, row)):
            others = taken.setdefault((row[i], item[i]), [])
            if all(end[i] <= s or start[i] >= e for s, e in others):
                others.append((start[i], end[i]))
                keep.append(i)
        keep = np.array(keep, np.int64)
        keep = keep[np.lexsort((item[keep], start[keep], row[keep]))]
        return row[keep], self.ids[item[keep]], start[keep], end[keep], edits[keep]


def _matches(index: Index, texts: pa.Array) -> pa.Array:
    raw, bounds = buffers(texts)
    got = []
    for i, j in slices(bounds, 1 << 20):
        data, offsets = raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        clean, own, at = normal(data, offsets)
        row, item, start, end, edits = index.matches(clean, own)
        if len(row):
            chars = char_index(data)
            base = chars[offsets[row]]
            last = at[end - 1] + 1
            while (more := (last < len(data)) & ((data[np.minimum(last, len(data) - 1)] & 0xC0) == 0x80)).any():
                last += more
            got.append((row + i, item, chars[at[start]] - base, chars[last] - base, edits))
    row, item, start, end, edits = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 5
    values = pa.StructArray.from_arrays([pa.array(item, pa.int64()), *(pa.array(x, pa.int32()) for x in (start, end, edits))], fields=list(MATCH))
    return lists(values, np.bincount(row, minlength=len(texts)))


def shards(benchmark: DataFrame, item: str, text: str, most: int = SHARD_CHARS) -> Iterator[tuple[list[int], list[str]]]:
    ids, texts, size = [], [], 0
    for i, t in benchmark.select(benchmark[item].cast("long"), benchmark[text]).filter(benchmark[item].isNotNull() & benchmark[text].isNotNull()).toLocalIterator():
        if ids and size + len(t) > most:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(t)
        size += len(t)
    if ids:
        yield ids, texts


def finder(spark: SparkSession, ids: list[int], texts: list[str], q: int = Q, rate: float = RATE):
    """An Arrow UDF from a text to its MATCHES with these items."""
    items = spark.sparkContext.broadcast((ids, texts))

    @F.arrow_udf(MATCHES)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Index(*items.value, q, rate)
        for b in batches:
            yield _matches(index, b)

    return find


def passes(text: Column, benchmark: DataFrame, *, item: str = "item_id", item_text: str = "text", q: int = Q, rate: float = RATE, shard_chars: int = SHARD_CHARS, pass_shards: int = PASS_SHARDS) -> Iterator[Column]:
    """Columns of MATCHES, which together have all items: one for each pass."""
    found = (finder(benchmark.sparkSession, *shard, q, rate)(text) for shard in shards(benchmark, item, item_text, shard_chars))
    while some := list(islice(found, pass_shards)):
        yield F.concat(*some) if len(some) > 1 else some[0]


def contaminated(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, item_id, start, end, edits): one row for each occurrence, positions in characters of the text."""
    each = [docs.select(docs[key].alias("k"), F.explode(m).alias("m")) for m in passes(docs[text], benchmark, **options)]
    found = reduce(DataFrame.union, each or [docs.limit(0).select(docs[key].alias("k"), F.explode(F.array().cast(MATCHES)).alias("m"))])
    return found.select(F.col("k").alias(key), F.col("m.item").alias("item_id"), "m.start", "m.end", "m.edits")


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The rows of docs in which no item occurs, with all their columns."""
    out = docs
    for m in passes(docs[text], benchmark, **options):
        out = out.filter(F.size(m) == 0)
    return out
