"""Substring dedup with a count-min prefilter.

Words are runs of ASCII letters, digits and non-ASCII characters, case folded.
Every window of ``words`` words is looked at, so every passage of so many words that
stands in two places is found, from its first word to its last.

1. Texts are dealt into chunks by a hash, compressed on their way. Each chunk makes a
   count-min sketch of all its windows: ``depth`` rows of counters, which saturate at 2.
   Its non-zero counters go to the tasks that own their ranges, in order, as compressed
   gaps. There the sketches of all chunks are added up; a chunk gets back one bit for
   each counter that it sent: whether the sum is 2 or more.
2. A chunk's windows all of whose counters are 2 or more may be repeated; counters only
   overestimate, so no repeated window is lost. Those windows alone are grouped exactly,
   by 112 bits of hash: first in the chunk, then, one entry for each window of a chunk,
   over all chunks. What is found once after all is dropped.
3. The windows of a text that overlap become one span.

No task gets more of a window, however popular, than one entry for each chunk. A chunk
sends a message to each of the tasks (``spark.sql.shuffle.partitions``): with very many of
those ``chunk_bytes`` should grow too, so that messages stay larger than their frames. The
rows of the sketch are as wide as ``load`` times the windows (as estimated from the
bytes of the texts); that decides how many windows pass in vain, and nothing else.

Result: (key, start, end, windows, copies, first): a span of characters of the
text, how many of its windows are repeated, in how many places the most frequent
one stands, and whether any of its windows stands here for the first time (in order
of key and position). Dropping the spans where none does leaves a copy of everything.

Defined results:

* a null key or text, and a text of fewer than ``words`` words, have no spans;
* repeated rows (same key and text) count once; one key with two texts stands for
  two texts, which are told apart by a hash of the text and come in any order;
* repetition within a text counts; of equal windows the first one in order is taken;
* a text is never cut: a very long one makes a large chunk;
* other columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphsieve.llm.shared import written
from glyphsieve.llm.textops import U64, buffers, char_index, expanded, fold, mix, powers, slices, span_hashes, squeezed, words

WORDS = 40
DEPTH = 2
#: Counters in a row of the sketch for each window.
LOAD = 16
#: Bytes of text in a chunk.
CHUNK_BYTES = 4 << 20
#: Bits of the second hash of a window.
MORE = U64((1 << 48) - 1)
#: Counters that a task adds up at a time.
BLOCK = 1 << 24


def window_hashes(word: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """A hash of the n neighbouring words that begin at each place."""
    power, inverse = powers(len(word) + 1)
    total = np.zeros(len(word) + 1, U64)
    np.cumsum(word * power[: len(word)], out=total[1:])
    return mix((total[at + n] - total[at]) * inverse[at] + U64(n))


def windows_of(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """(hash of each word, first word of each window, its row, its hash, start and end byte of each word) of rows."""
    start, end, row = words(data, offsets)
    word = span_hashes(fold(data), start, end)
    m = max(0, len(word) - n + 1)
    at = np.flatnonzero(row[:m] == row[n - 1 :]) if m else np.zeros(0, np.int64)
    return word, at, row[at], window_hashes(word, n, at), start, end


def sketch(hashes: np.ndarray, depth: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(the non-zero counters of a count-min sketch in order, which of them are 2 or more); row d has counters [d * width, (d + 1) * width)."""
    cells = np.sort(np.concatenate([cells_of(hashes, d, width) for d in range(depth)]))
    new = np.ones(len(cells), dtype=bool)
    new[1:] = cells[1:] != cells[:-1]
    first = np.flatnonzero(new)
    return cells[first], np.diff(np.append(first, len(cells))) > 1


def cells_of(hashes: np.ndarray, d: int, width: int) -> np.ndarray:
    return (mix(hashes + U64(d + 1)) % U64(width) + U64(d * width)).astype(np.int64)


def _ranges(cells: np.ndarray, size: int, tasks: int) -> np.ndarray:
    """Where the counters of each task begin (and the last one's end)."""
    return np.searchsorted(cells, np.arange(tasks + 1) * size)


PACKED = pa.schema([("chunk", pa.int64()), ("n", pa.int64()), ("blob", pa.binary())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of a batch by chunk, compressed: keys, hashes and lengths, then the bytes."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for b in batches:
        chunk, k, t = (b.column(c).to_numpy() for c in ("chunk", "k", "t"))
        data, offsets = buffers(b.column("text"))
        order = np.argsort(chunk, kind="stable")
        cut = np.flatnonzero(np.r_[True, chunk[order][1:] != chunk[order][:-1], True]) if len(order) else [0]
        rows = []
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            on = order[s:e]
            head = np.stack([k[on], t[on], offsets[on + 1] - offsets[on]]).astype("<i8").tobytes()
            rows.append((int(chunk[on[0]]), len(on), squeeze.compress(head + b"".join(data[offsets[i] : offsets[i + 1]].tobytes() for i in on))))
            if len(rows) == 64 or e == len(order):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PACKED, strict=True)], schema=PACKED)
                rows = []


def _distinct(packed: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """(keys, texts) of a chunk in order of key and text, repeated rows once."""
    heads, parts = [], []
    for n, blob in zip(packed["n"].to_pylist(), packed["blob"].to_pylist(), strict=True):
        whole = zstandard.ZstdDecompressor().decompress(blob)
        heads.append(np.frombuffer(whole, "<i8", count=3 * n).reshape(3, n))
        parts.append(whole[24 * n :])
    k, t, size = np.concatenate(heads, axis=1)
    ends = np.concatenate([[0], np.cumsum(size)])
    texts = pa.Array.from_buffers(pa.large_string(), len(k), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(b"".join(parts))])
    order = np.lexsort((t, k))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (k[order[1:]] != k[order[:-1]]) | (t[order[1:]] != t[order[:-1]])
    order = order[new]
    return k[order], texts.take(pa.array(order))


def _hashes(texts: pa.Array, n: int) -> np.ndarray:
    data, offsets = buffers(texts)
    got = [windows_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)[3] for i, j in slices(offsets, 1 << 20)]
    return np.concatenate(got) if got else np.zeros(0, U64)


def _several(columns: Iterable[np.ndarray]) -> bytes:
    """Columns of 64-bit numbers, squeezed, each behind its length."""
    return b"".join(len(x).to_bytes(8, "little") + x for x in map(squeezed, columns))


def _apart(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 8], "little")
        out.append(expanded(blob[at + 8 : at + 8 + n]))
        at += 8 + n
    return out


MESSAGE = pa.schema([("r", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary()), ("more", pa.binary())])
MESSAGE_DDL = "r int, chunk long, blob binary, more binary"


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 4, MESSAGE, strict=True)], schema=MESSAGE)


def _sketched(tasks: int, n: int, depth: int, width: int):
    """A chunk's sketch by ranges of counters: gaps, and bits for those of 2 or more."""
    size = -(-depth * width // tasks)

    def run(texts: pa.Table) -> pa.Table:
        cells, twice = sketch(_hashes(_distinct(texts)[1], n), depth, width)
        cut, chunk = _ranges(cells, size, tasks), texts["chunk"][0].as_py()
        return _table([(r, chunk, squeezed(cells[s:e] - r * size), np.packbits(twice[s:e]).tobytes()) for r, (s, e) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if s < e])

    return run


def added(sketches: list[tuple[np.ndarray, np.ndarray]], size: int) -> list[np.ndarray]:
    """Of sketches (counters below size, which are 2 or more): for each one's counters whether the sum of all is 2 or more."""
    out = [np.zeros(len(cells), dtype=bool) for cells, _ in sketches]
    for begin in range(0, size, BLOCK):
        sums = np.zeros(min(BLOCK, size - begin), np.uint8)
        parts = [np.searchsorted(cells, (begin, begin + BLOCK)) for cells, _ in sketches]
        for (cells, twice), (s, e) in zip(sketches, parts, strict=True):
            at = cells[s:e] - begin
            sums[at] = np.minimum(sums[at] + np.uint8(1) + twice[s:e], 2)
        for bits, (cells, _), (s, e) in zip(out, sketches, parts, strict=True):
            bits[s:e] = sums[cells[s:e] - begin] > 1
    return out


def _merged(size: int):
    """The sketches of all chunks, added up over a range; each gets back which of its counters are 2 or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for b in batches:
            for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                by.setdefault(x[0], []).append(x)
        for got in by.values():
            sketches = []
            for *_, gaps, twice in got:
                cells = expanded(gaps)
                sketches.append((cells, np.unpackbits(np.frombuffer(twice, np.uint8), count=len(cells))))
            rows = [(r, chunk, np.packbits(bits).tobytes(), None) for (r, chunk, *_), bits in zip(got, added(sketches, size), strict=True)]
            yield from _table(rows).to_batches(max_chunksize=64)

    return run


def _marked(tasks: int, n: int, depth: int, width: int):
    """The windows of a chunk that may be repeated: an entry for each hash by target task, and, at -1, their places.

    Entries: two hashes, the least key, how many places. The places: key and number of windows by text, then their entries, starts and ends."""
    size = -(-depth * width // tasks)

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(texts) or not len(answers):
            return _table([])
        key, text = _distinct(texts)
        data, offsets = buffers(text)
        parts, hashes = [], []
        for i, j in slices(offsets, 1 << 20):
            word, begin, row, own, start, end = windows_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
            hashes.append(own)
            parts.append((i, j, word, *(x.astype(np.int32) for x in (begin, row, start, end))) if offsets[j] - offsets[i] < 1 << 31 else (i, j, word, begin, row, start, end))
        h = np.concatenate(hashes)
        cells, _ = sketch(h, depth, width)
        cut = _ranges(cells, size, tasks)
        said = dict(zip(answers["r"].to_pylist(), answers["blob"].to_pylist(), strict=True))
        bits = [np.unpackbits(np.frombuffer(said[r], np.uint8), count=e - s) for r, (s, e) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if s < e]
        many = cells[np.concatenate(bits).astype(bool)]
        if not len(many):
            return _table([])
        near = np.zeros(1 << 22, dtype=bool)
        near[many & (len(near) - 1)] = True
        on = np.arange(len(h))
        for d in range(depth):
            own = cells_of(h[on], d, width)
            some = near[own & (len(near) - 1)]
            on, own = on[some], own[some]
            on = on[many[np.minimum(np.searchsorted(many, own), len(many) - 1)] == own]
        rows, first, last, g, at = [], [], [], [], 0
        for i, j, word, begin, row, start, end in parts:
            s, e = np.searchsorted(on, (at, at + len(begin)))
            mine = on[s:e] - at
            at += len(begin)
            if not len(mine):
                continue
            g.append(window_hashes(mix(word + U64(0x51ED270B)), n, begin[mine]) & MORE)
            chars = char_index(data[offsets[i] : offsets[j]])
            base = chars[offsets[i + row[mine]] - offsets[i]]
            rows.append(i + row[mine])
            first.append(chars[start[begin[mine]]] - base)
            last.append(chars[end[begin[mine] + n - 1]] - base)
        if not rows:
            return _table([])
        row, first, last, g = map(np.concatenate, (rows, first, last, g))
        h, chunk = h[on], texts["chunk"][0].as_py()
        order = np.lexsort((np.arange(len(h)), g, h))  # equal ones in order of their places
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[order[1:]] != h[order[:-1]]) | (g[order[1:]] != g[order[:-1]])
        entry = np.empty(len(h), np.int64)
        entry[order] = np.cumsum(new) - 1
        head = order[new]
        count = np.diff(np.append(np.flatnonzero(new), len(h)))
        lot = (h[head], g[head], key[row[head]], count)
        target = ((h[head] >> U64(40)) * U64(tasks)) >> U64(24)  # ascending, as h is
        edge = np.searchsorted(target, np.arange(tasks + 1))
        out = [(r, chunk, _several(x[s:e] for x in lot), None) for r, (s, e) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if s < e]
        texts_on, run = np.unique(row, return_counts=True)
        out.append((-1, chunk, _several((key[texts_on], run)), _several((entry, first, last))))
        return _table(out)

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk's entries: in how many places the window stands, and whether the chunk has the first one."""
    by: dict[int, list] = {}
    for b in batches:
        for r, chunk, blob, _ in zip(*(c.to_pylist() for c in b.columns), strict=True):
            by.setdefault(r, []).append((chunk, np.stack(_apart(blob))))
    for r, got in by.items():
        h, g, key, count = np.concatenate([x for _, x in got], axis=1)
        chunk = np.repeat([c for c, _ in got], [x.shape[1] for _, x in got])
        order = np.lexsort((chunk, key, g, h))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (h[order[1:]] != h[order[:-1]]) | (g[order[1:]] != g[order[:-1]])
        cut = np.flatnonzero(new)
        total, first = np.empty(len(order), np.int64), np.zeros(len(order), dtype=bool)
        total[order] = np.repeat(np.add.reduceat(count[order], cut), np.diff(np.append(cut, len(order))))
        first[order[cut]] = True
        at, rows = 0, []
        for c, x in got:
            e = at + x.shape[1]
            rows.append((r, c, squeezed(total[at:e]), np.packbits(first[at:e]).tobytes()))
            at = e
        yield from _table(rows).to_batches(max_chunksize=64)


SPANS = "k long, start int, end int, windows int, copies int, first boolean"


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of the texts of each chunk, from its places and what is known of its entries."""
    by: dict[int, list] = {}
    for b in batches:
        for r, chunk, blob, more in zip(*(c.to_pylist() for c in b.columns), strict=True):
            by.setdefault(chunk, []).append((r, blob, more))
    for got in by.values():
        (_, texts, places), *answers = sorted(got)
        totals = [expanded(x) for _, x, _ in answers]
        fresh = np.concatenate([np.unpackbits(np.frombuffer(y, np.uint8), count=len(x)) for x, (*_, y) in zip(totals, answers, strict=True)]).astype(bool)
        total = np.concatenate(totals)
        key, run = _apart(texts)
        entry, start, end = _apart(places)
        row = np.repeat(np.arange(len(key)), run)
        first = np.zeros(len(entry), dtype=bool)
        first[np.unique(entry, return_index=True)[1]] = fresh  # of a chunk's places the first in order
        copies = total[entry]
        on = np.flatnonzero(copies > 1)
        if not len(on):
            continue
        row, start, end, copies, first = (x[on] for x in (row, start, end, copies, first))
        # windows of a text come in order, and each ends after all that begin before it
        new = np.ones(len(on), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (start[1:] > end[:-1])
        cut = np.flatnonzero(new)
        n = np.diff(np.append(cut, len(on)))
        out = (key[row[cut]], start[cut].astype(np.int32), end[np.append(cut[1:], len(on)) - 1].astype(np.int32), n.astype(np.int32), np.maximum.reduceat(copies, cut).astype(np.int32), np.logical_or.reduceat(first, cut))
        for i in range(0, len(cut), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)]) for c in out], ["k", "start", "end", "windows", "copies", "first"])


def repeated_spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, depth: int = DEPTH, load: float = LOAD, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(key, start, end, windows, copies, first): see the module."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(docs[key].cast("long").alias("k"), F.xxhash64(docs[text]).alias("t"), docs[text].alias("text")).filter("k is not null and text is not null")
    size = docs.agg(F.sum(F.octet_length(docs[text]))).first()[0] or 0
    chunks, width = max(1, -(-size // chunk_bytes)), max(1, int(load * size / 6))
    packed = texts.withColumn("chunk", F.pmod(F.xxhash64("k", "t"), F.lit(chunks))).mapInArrow(_pack, "chunk long, n long, blob binary")
    placed = packed.repartition(min(tasks, chunks), "chunk")
    sketches = placed.groupBy("chunk").applyInArrow(_sketched(tasks, words, depth, width), MESSAGE_DDL)
    answers = sketches.repartitionById(tasks, F.col("r")).mapInArrow(_merged(-(-depth * width // tasks)), MESSAGE_DDL)
    # the texts' shuffle is the one of the sketches, used again
    marked = written(placed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_marked(tasks, words, depth, width), MESSAGE_DDL))
    known = marked.filter("r >= 0").repartitionById(tasks, F.col("r")).mapInArrow(_exact, MESSAGE_DDL)
    spans = marked.filter("r < 0").unionByName(known).repartition(tasks, "chunk").mapInArrow(_spans, SPANS)
    return spans.select(F.col("k").alias(key), "start", "end", "windows", "copies", "first")


def oracle(n: int = WORDS) -> str:
    """The rows of repeated_spans() in DuckDB's SQL: every window of every text, grouped by its words."""
    sign = r"[A-Za-z0-9\x{80}-\x{10FFFF}]"
    other = sign.replace("[", "[^")
    return f"""
WITH texts AS (
  SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), split AS (
  SELECT doc_id, md5(text) AS t, regexp_extract_all(text, '({other}*)({sign}+)', 1) AS gaps, regexp_extract_all(text, '({other}*)({sign}+)', 2) AS ws FROM texts
), folded AS (
  SELECT *, [lower(x) FOR x IN ws] AS low FROM split
), word AS (
  SELECT doc_id, t, unnest(range(1, len(ws) + 1)) AS i, unnest(gaps) AS gap, unnest(ws) AS w,
    unnest([CASE WHEN j + {n - 1} <= len(low) THEN md5(array_to_string(list_slice(low, j, j + {n - 1}), ' ')) END FOR j IN range(1, len(low) + 1)]) AS h FROM folded
), placed AS (
  SELECT doc_id, t, i, h, length(w) AS size, sum(length(gap) + length(w)) OVER (PARTITION BY doc_id, t ORDER BY i) AS until FROM word
), windows AS (
  SELECT doc_id, t, i, h, until - size AS start, lead(until, {n - 1}) OVER (PARTITION BY doc_id, t ORDER BY i) AS stop FROM placed
), counted AS (
  SELECT *, count(*) OVER (PARTITION BY h) AS copies, row_number() OVER (PARTITION BY h ORDER BY doc_id, start) = 1 AS fresh FROM windows WHERE h IS NOT NULL
), repeated AS (
  SELECT *, CASE WHEN start <= lag(stop) OVER (PARTITION BY doc_id, t ORDER BY start) THEN 0 ELSE 1 END AS new FROM counted WHERE copies > 1
), grouped AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id, t ORDER BY start) AS span FROM repeated
)
SELECT doc_id, CAST(min(start) AS INTEGER) AS start, CAST(max(stop) AS INTEGER) AS "end", CAST(count(*) AS INTEGER) AS windows, CAST(max(copies) AS INTEGER) AS copies, bool_or(fresh) AS first
FROM grouped GROUP BY doc_id, t, span
"""
