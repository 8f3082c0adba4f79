"""N-gram Jaccard join: multiple-global-order filtering.

A text is the set of its word n-grams (ASCII letters, digits and non-ASCII
characters make a word; case is folded). Two sets are similar when their Jaccard
coefficient reaches ``threshold``. Under any one order of all grams, two similar
sets share a gram of their prefixes, the first ``n - ceil(threshold * n) + 1``
grams; so a candidate pair must do so under each of ``ORDERS`` orders. Those put
rare grams first and break ties by different hashes.

How it runs, each step over all rows that the one before left:

1. The grams of all texts are counted. A task gathers chunks of texts. A gram that two
   sets of a chunk have is known to be shared there and then: it is sent on once,
   however often the chunk has it. Of the others only the places of those found
   elsewhere too come back. A text with fewer than ``ceil(threshold * n)`` shared grams
   has no partner.
2. Equal sets become one set. The table of keys by set holds numbers only.
3. Counts over what is left, added up by chunk before they are sent, give the orders.
   The sets that share a gram of their prefixes under the first order meet in signatures
   of two to four bits a gram: each bit is the parity of the grams that fall on it, so
   bits that differ bound the overlap from above, and no similar pair fails. What a
   task's pairs link goes on as a few edges. Components over all tasks are the cells.
   Texts that only share rare grams, one with the next, would else be one cell.
4. Cells meet in blocks of bounded size, every two blocks of a cell in a task of
   their own. There the prefixes are compared pair by pair under each order, and
   pairs that pass them all are verified by their exact overlap. A block gives each
   set's number of links and a few edges that span its groups, not the pairs.

No partner is left out. In steps 1 and 2 no task gets more of a gram, however frequent,
than one entry for each chunk; in step 3 one for each set that has it in its prefix. What
a cell of sets that are all alike costs is the number of its pairs.

Result: a row (doc_id, class_id, copies, links) for each key that has a partner.
class_id is the least key of the group that links connect it with; copies, how many
other keys have an equal set; links, how many different sets reach the threshold with
its own.

Defined results:

* a null key, and a text that is null or has no word, is in no row;
* a text of fewer than n words is the set of one gram, all its words; a very long text
  is one set as any other;
* repeated rows count once: a key is never its own copy; a key that comes with two
  texts stands for both of its sets, which may link to each other, and its copies and
  links are those of both together;
* other columns are not read, whatever their names; empty tables give an empty result.

A task that is run again must see its rows in the same order, as it does where docs is read
from files (or written before); chunks are named by partition and number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphsieve.llm.graph import components, local_components
from glyphsieve.llm.shared import small, written
from glyphsieve.llm.textops import U64, ascending, buffers, distinct, mix, slices, span_hashes, word_ngrams, words

N = 3
THRESHOLD = 0.6
ORDERS = 3
#: Grams that a task gathers before it sends them on, and those of a chunk of sets.
CHUNK, CHUNK_SETS = 1 << 21, 1 << 20
#: Tables of keys are broadcast up to so many bytes (as counted by ``small``); larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
BLOCK_GRAMS, BLOCK_TEXTS = 1_000_000, 1000
#: Sets with a gram in common meet pair by pair up to so many; more of them meet group by group, so many pairs at a time.
FEW, TESTS = 32, 1 << 18
M48 = U64((1 << 48) - 1)


def least_overlap(n, threshold: float):
    """ceil(threshold * n), safe from floating-point dust."""
    return np.ceil(np.asarray(n) * threshold - 1e-9).astype(np.int64)


def prefix_length(n, threshold: float):
    return np.asarray(n) - least_overlap(n, threshold) + 1


def _pack(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(blob: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _planes(values: np.ndarray) -> bytes:
    """Differences by byte planes: easy to compress."""
    d = np.diff(values.astype(np.int64), prepend=np.int64(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(blob: bytes) -> np.ndarray:
    d = np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(np.int64).ravel()
    return np.cumsum(d)


def _steps(rows: np.ndarray) -> bytes:
    """Ascending row numbers as steps of one byte, or of four behind a mark."""
    d = np.diff(rows, prepend=0)
    return b"\1" + d.astype(np.uint8).tobytes() if not len(d) or d.max() < 256 else b"\4" + d.astype("<u4").tobytes()


def _from_steps(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, np.uint8 if blob[:1] == b"\1" else "<u4", offset=1).astype(np.int64))


def gram_sets(texts: pa.Array, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(row, 48-bit gram, i, j) for runs of rows [i, j): distinct grams, ascending in each row."""
    data, offsets = buffers(texts)
    for i, j in slices(offsets, 1 << 20, 1 << 16):
        part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        start, end, row = words(part, own)
        gram, first = word_ngrams(span_hashes(part, start, end), row, n)
        key = distinct((row[first].astype(U64) << U64(48)) | (gram >> U64(16)))
        yield (key >> U64(48)).astype(np.int64) + i, key & M48, i, j


SENT = pa.schema([("r", pa.int32()), ("chunk", pa.int64()), ("ids", pa.binary()), ("n", pa.binary()), ("known", pa.binary()), ("steps", pa.binary()), ("grams", pa.binary()), ("often", pa.binary())])
SENT_DDL = "r int, chunk long, ids binary, n binary, known binary, steps binary, grams binary, often binary"


def _batches(rows: list[tuple], schema: pa.Schema, most: int = 64) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), most):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + most], strict=True), schema, strict=True)], schema=schema)


def _targets(mixed: np.ndarray, tasks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by target task, where each target's run is cut, the targets of the runs)."""
    target = (((mixed & U64(0xFFFFFF)) * U64(tasks)) >> U64(24)).astype(np.int64)
    order = np.argsort(target.astype(np.uint16) if tasks <= 1 << 16 else target, kind="stable")
    target = target[order]
    cut = np.flatnonzero(np.r_[True, target[1:] != target[:-1], True]) if len(target) else np.zeros(1, np.int64)
    return order, cut, target[cut[:-1]]


def _send(chunk: int, ids: np.ndarray, row: np.ndarray, gram: np.ndarray, tasks: int) -> Iterator[pa.RecordBatch]:
    """A chunk of sets by target task: places and hashes of the grams that one set has, hashes of those that more have.

    The keys, sizes and numbers of grams known to be shared go along once, with the first target."""
    n = np.bincount(row, minlength=len(ids))
    mixed = mix(gram)
    order = ascending(mixed)
    a = mixed[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = a[1:] != a[:-1]
    alone = new.copy()
    alone[:-1] &= new[1:]
    one = np.zeros(len(order), dtype=bool)
    one[order[alone]] = True
    one = np.flatnonzero(one)
    known = n - np.bincount(row[one], minlength=len(ids))
    often = a[new & ~alone]
    by: dict[int, list[bytes]] = {}
    mixed = mixed[one]
    rest, cut, target = _targets(mixed, tasks)
    own_row, value = row[one][rest], (mixed >> U64(24))[rest]
    for t, s, e in zip(target, cut[:-1], cut[1:], strict=True):
        by[int(t)] = [_steps(own_row[s:e]), _pack(value[s:e], 5), b""]
    rest, cut, target = _targets(often, tasks)
    value = (often >> U64(24))[rest]
    for t, s, e in zip(target, cut[:-1], cut[1:], strict=True):
        by.setdefault(int(t), [_steps(own_row[:0]), b"", b""])[2] = _pack(value[s:e], 5)
    heads = iter([(_planes(ids), _planes(n), _planes(known))])
    yield from _batches([(t, chunk, *next(heads, (None, None, None)), *x) for t, x in by.items()], SENT)


def _send_texts(n: int, tasks: int, most: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a name of the chunk's own: partition and running number, the same if the task is run again
        chunk = TaskContext.get().partitionId() << 32
        ids, rows, grams, count, size = [], [], [], 0, 0
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False)
            for row, gram, i, j in gram_sets(b.column(1), n):
                ids.append(own[i:j])
                rows.append(row - i + count)
                grams.append(gram)
                count, size = count + j - i, size + len(gram)
                if size >= most:
                    yield from _send(chunk, np.concatenate(ids), np.concatenate(rows), np.concatenate(grams), tasks)
                    ids, rows, grams, count, size = [], [], [], 0, 0
                    chunk += 1
        if size:
            yield from _send(chunk, np.concatenate(ids), np.concatenate(rows), np.concatenate(grams), tasks)

    return send


def _found_elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of what a task got: the places of grams found in two sets or more, for the chunks that they came from."""
    by: dict[int, list] = {}
    for b in batches:
        for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
            by.setdefault(x[0], []).append(x[1:])
    for got in by.values():
        grams = [_unpack(g, 5) for *_, g, _ in got]
        often = distinct(_unpack(b"".join(x[-1] for x in got), 5))
        whole = np.concatenate(grams)
        order = ascending(whole << U64(24))
        a = whole[order]
        same = np.zeros(len(a), dtype=bool)
        same[1:] = a[1:] == a[:-1]
        same[:-1] |= same[1:]
        if len(often):
            at = np.minimum(np.searchsorted(often, a), len(often) - 1)
            same |= often[at] == a
        many = np.empty(len(a), dtype=bool)
        many[order] = same
        at, out = 0, []
        for (chunk, ids, n, known, steps, *_), g in zip(got, grams, strict=True):
            on = many[at : at + len(g)]
            at += len(g)
            if ids is not None or on.any():
                out.append((0, chunk, ids, n, known, _steps(_from_steps(steps)[on]), None, None))
        yield from _batches(out, SENT)


def _alive(threshold: float):
    def alive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for b in batches:
            for _, chunk, ids, n, known, steps, _, _ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                one = by.setdefault(chunk, [None, []])
                if ids is not None:
                    one[0] = (ids, n, known)
                one[1].append(steps)
        for head, parts in by.values():
            ids, n, shared = map(_from_planes, head)
            for steps in parts:
                shared = shared + np.bincount(_from_steps(steps), minlength=len(ids))
            on = (n > 0) & (shared >= least_overlap(n, threshold))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(ids[on]))], ["k"])

    return alive


def _sets(n: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, gram, i, j in gram_sets(b.column(1), n):
                counts = np.bincount(row - i, minlength=j - i)
                blob = _pack(gram, 6)
                offsets = np.zeros(j - i + 1, np.int32)
                np.cumsum(counts * 6, out=offsets[1:])
                packed = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(blob)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), packed], ["k", "grams"])

    return sets


def _seed(k: int) -> np.uint64:
    return U64((0xD6E8FEB86659FD93 * (2 * k + 1)) & (2**64 - 1))


def prefixes(row: np.ndarray, gram: np.ndarray, count: np.ndarray, left: np.ndarray, k: int) -> np.ndarray:
    """Which entries lie in their rows' prefixes under order k; left: how many of a row may."""
    order = np.lexsort((mix(gram ^ _seed(k)), count, row))
    r = row[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    on = np.zeros(len(r), dtype=bool)
    on[order] = place < left[r]
    return on


def _grams_of(sets: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, size of each row's set) of packed sets."""
    n = sets["n"].to_numpy().astype(np.int64)
    return np.repeat(np.arange(len(n)), n), _unpack(b"".join(x.as_py() for x in sets["grams"]), 6), n


ASKED = pa.schema([("r", pa.int32()), ("chunk", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])


def _ask(tasks: int):
    """How often the chunk has each of its grams, by target task."""

    def ask(sets: pa.Table) -> pa.Table:
        _, gram, _ = _grams_of(sets)
        gram, count = np.unique(gram, return_counts=True)
        order, cut, target = _targets(mix(gram), tasks)
        gram, count = gram[order], np.minimum(count[order], 65535).astype("<u2")
        chunk = sets["chunk"][0].as_py()
        return pa.Table.from_batches(_batches([(int(t), chunk, _pack(gram[s:e], 6), count[s:e].tobytes()) for t, s, e in zip(target, cut[:-1], cut[1:], strict=True)], ASKED), ASKED)

    return ask


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In place of a chunk's own counts those of all chunks, in the same order."""
    by: dict[int, list] = {}
    for b in batches:
        for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
            by.setdefault(x[0], []).append(x)
    for got in by.values():
        grams = _unpack(b"".join(x[2] for x in got), 6)
        counts = np.frombuffer(b"".join(x[3] for x in got), "<u2").astype(np.int64)
        _, at = np.unique(grams, return_inverse=True)
        total = np.minimum(np.bincount(at, counts), 65535).astype("<u2")[at]
        ends = np.cumsum([len(x[3]) // 2 for x in got])
        yield from _batches([(x[0], x[1], None, total[e - len(x[3]) // 2 : e].tobytes()) for x, e in zip(got, ends, strict=True)], ASKED)


LINKS = pa.schema([("r", pa.int32()), ("ids", pa.binary()), ("n", pa.binary()), ("counts", pa.binary()), ("bits", pa.binary()), ("grams", pa.binary())])
LINKS_DDL = "r int, ids binary, n binary, counts binary, bits binary, grams binary"


def signature_words(n: np.ndarray) -> np.ndarray:
    """How many 64-bit words a set's signature has: a power of two, two bits a gram at least, 8192 bits at most."""
    return np.int64(1) << np.ceil(np.log2(np.clip(n, 32, 4096) / 32)).astype(np.int64)


def signatures(row: np.ndarray, gram: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sets' signatures, one behind the other: each bit is the parity of the grams that fall on it."""
    size = signature_words(n) * 64
    start = np.cumsum(size) - size
    at = start[row] + (mix(gram ^ _seed(77)) & (size[row] - 1).astype(U64)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=int(size.sum())) & 1).astype(np.uint8), bitorder="little").view("<u8")


def may_link(i: np.ndarray, j: np.ndarray, n: np.ndarray, start: np.ndarray, bits: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sets may reach the threshold by their sizes and signatures; none that does is left out.

    Every bit in which two signatures differ is a gram of only one of the sets. The wider one is folded first."""
    out = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-6
    most = (n[i] + n[j]) * ((1 - threshold) / (1 + threshold)) + 1e-6
    wide, other = (signature_words(n[x]) for x in (i, j))
    kind = wide << 8 | other
    for both in np.unique(kind[out]).tolist():
        on = np.flatnonzero(out & (kind == both))
        width = min(both >> 8, both & 255)
        step = max(1, (1 << 18) // max(both >> 8, both & 255))
        for s in range(0, len(on), step):
            part = on[s : s + step]
            x, y = (np.bitwise_xor.reduce(bits[start[z[part], None] + np.arange(w)].reshape(len(part), -1, width), axis=1) for z, w in ((i, both >> 8), (j, both & 255)))
            out[part] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= most[part]
    return out


def _links(threshold: float, tasks: int):
    """By target task the sets that have grams of their prefixes (of the first order) there: sizes, signatures and those grams."""

    def links(sets: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(sets):
            return pa.Table.from_batches([], LINKS)
        row, gram, n = _grams_of(sets)
        ids, size = sets["rid"].to_numpy(), signature_words(n)
        bits, start = signatures(row, gram, n), np.cumsum(size) - size
        values, at = np.unique(gram, return_inverse=True)
        order, cut, target = _targets(mix(values), tasks)
        total = np.zeros(len(values), np.int64)
        said = dict(zip(answers["r"].to_pylist(), answers["counts"].to_pylist(), strict=True))
        for t, s, e in zip(target, cut[:-1], cut[1:], strict=True):
            total[order[s:e]] = np.frombuffer(said[int(t)], "<u2")
        count = total[at]
        shared = count > 1  # grams of one set alone come first in every order and link nothing
        row, gram, count = row[shared], gram[shared], count[shared]
        left = prefix_length(n, threshold) - (n - np.bincount(row, minlength=len(ids)))
        on = prefixes(row, gram, count, left, 0)
        row, gram = row[on], gram[on]
        order, cut, target = _targets(mix(gram), tasks)
        row, gram = row[order], gram[order]  # in each target by row still
        out = []
        for t, s, e in zip(target, cut[:-1], cut[1:], strict=True):
            who, counts = np.unique(row[s:e], return_counts=True)
            own = np.repeat(start[who] - np.cumsum(size[who]) + size[who], size[who]) + np.arange(size[who].sum())
            out.append((int(t), ids[who].astype("<i8").tobytes(), n[who].astype("<i4").tobytes(), counts.astype("<i4").tobytes(), bits[own].tobytes(), _pack(gram[s:e], 6)))
        return pa.Table.from_batches(_batches(out, LINKS), LINKS)

    return links


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The labels once each i is in one group with its j."""
    if not len(i):
        return label
    node, least = local_components(label[i], label[j])
    to = np.arange(len(label))
    to[node] = least
    return to[label]


def groups(who: np.ndarray, gram: np.ndarray, n: np.ndarray, bits: np.ndarray, threshold: float) -> np.ndarray:
    """A label for each set, the same for any two that share a gram and may be similar (and for those they are so linked with).

    Pairs of one label aren't looked at again, so a gram of many copies costs little more than their number."""
    m, size = len(n), signature_words(n)
    start = np.cumsum(size) - size
    order = ascending(gram << U64(16))  # who ascends, so it does for each gram
    who, gram = who[order], gram[order]
    cut = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    run = np.diff(np.append(cut, len(gram)))
    pairs = [np.zeros(0, np.int64)]
    for d in np.unique(run[(run > 1) & (run <= FEW)]).tolist():
        at, (a, b) = cut[run == d], np.triu_indices(d, 1)
        step = max(1, (1 << 20) // len(a))
        for s in range(0, len(at), step):
            r = who[at[s : s + step, None] + np.arange(d)]
            pairs.append(distinct((r[:, a] * np.int64(m) + r[:, b]).ravel()))
    i, j = np.divmod(distinct(np.concatenate(pairs)), m)
    on = may_link(i, j, n, start, bits, threshold)
    label = _joined(np.arange(m), i[on], j[on])
    for s, d in zip(cut[run > FEW].tolist(), run[run > FEW].tolist(), strict=True):
        left = who[s : s + d]
        while len(left):
            kinds, at, many = np.unique(label[left], return_inverse=True, return_counts=True)
            if len(kinds) == 1:
                break
            left = left[np.argsort(many[at], kind="stable")]  # sets of small groups first: one test with all others each, then they are done
            now = left[: max(1, TESTS // len(left))]
            i, j = np.repeat(now, len(left)), np.tile(left, len(now))
            on = label[i] != label[j]
            i, j = i[on], j[on]
            on = may_link(i, j, n, start, bits, threshold)
            label = _joined(label, i[on], j[on])
            left = left[len(now) :]
    return label


def _forest(threshold: float):
    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the sets that share a gram and may be similar: a few edges that link them."""
        got = [x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if not got:
            return
        ids, n, counts = (np.concatenate([np.frombuffer(x[c], kind) for x in got]).astype(np.int64) for c, kind in ((1, "<i8"), (2, "<i4"), (3, "<i4")))
        bits, gram = np.frombuffer(b"".join(x[4] for x in got), "<u8"), _unpack(b"".join(x[5] for x in got), 6)
        label = groups(np.repeat(np.arange(len(ids)), counts), gram, n, bits, threshold)
        node = np.flatnonzero(np.bincount(label, minlength=len(ids))[label] > 1)
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, label[node], ids[node])
        for i in range(0, len(node), 1 << 16):
            part = node[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(part), np.int32)), pa.array(ids[part]), pa.array(least[label[part]])], ["k", "a", "b"])

    return forest


def _cells(reps: DataFrame, chunks: int, tasks: int, threshold: float) -> DataFrame:
    """(rid, cell) of sets (rid, n, grams): any two similar ones are in one cell; others only by a chain of pairs that may be similar."""
    placed = reps.select("rid", "n", "grams", F.pmod(F.xxhash64("rid"), F.lit(chunks)).alias("chunk")).repartition(min(tasks, chunks), "chunk")
    asked = placed.groupBy("chunk").applyInArrow(_ask(tasks), "r int, chunk long, grams binary, counts binary")
    said = asked.repartitionById(tasks, F.col("r")).mapInArrow(_add_up, "r int, chunk long, grams binary, counts binary").drop("grams")
    links = placed.groupBy("chunk").cogroup(said.groupBy("chunk")).applyInArrow(_links(threshold, tasks), LINKS_DDL)
    edges = written(links.repartitionById(tasks, F.col("r")).mapInArrow(_forest(threshold), "k int, a long, b long").distinct())
    return components(edges).select(F.col("node").alias("rid"), F.col("component").alias("cell"))


def _pair_counts(row: np.ndarray, column: np.ndarray, m: int, split: int = 0) -> np.ndarray:
    """(m, m), or (split, m - split) of the first rows and the others: how many columns two rows share. Entries are distinct."""
    one, other = (slice(0, split), slice(split, m)) if split else (slice(0, m), slice(0, m))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    cut = np.flatnonzero(np.r_[True, column[1:] != column[:-1]]) if len(column) else np.zeros(0, np.int64)
    run = np.diff(np.append(cut, len(column)))
    total = np.zeros(m * m, np.int64)
    products = float(split * (m - split) if split else m * m)
    if float((run.astype(float) ** 2).sum()) * 3e-9 <= len(cut) * products * 1e-10 + len(cut) * m * 2e-9:
        for d in np.unique(run[run > 1]):
            at = cut[run == d]
            step = max(1, (1 << 21) // int(d * d))
            for i in range(0, len(at), step):
                r = row[at[i : i + step, None] + np.arange(d)]
                total += np.bincount((r[:, :, None] * m + r[:, None, :]).ravel(), minlength=m * m)
        return total.reshape(m, m)[one, other]
    total = np.zeros((m, m), np.float32)[one, other]
    number = np.repeat(np.arange(len(cut)), run)
    for i in range(0, len(cut), 4096):
        on = (number >= i) & (number < i + 4096)
        hot = np.zeros((m, min(4096, len(cut) - i)), np.float32)
        hot[row[on], number[on] - i] = 1
        total += hot[one] @ hot[other].T
    return total.astype(np.int64)


def similar(sets: list[np.ndarray], threshold: float, orders: int = ORDERS, split: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, coefficient) of all pairs i < j of sets that reach the threshold; with split only those of one of the first sets and one of the others."""
    m, n = len(sets), np.array([len(s) for s in sets])
    row = np.repeat(np.arange(m), n)
    gram = np.concatenate(sets)
    values, at, count = np.unique(gram, return_inverse=True, return_counts=True)
    on = count[at] > 1
    row, at, gram = row[on], at[on], gram[on]
    passed = np.ones((split, m - split) if split else (m, m), dtype=bool)
    left = prefix_length(n, threshold) - (n - np.bincount(row, minlength=m))
    for k in range(orders):
        in_prefix = prefixes(row, gram, count[at], left, k)
        passed &= _pair_counts(row[in_prefix], at[in_prefix], m, split) > 0
    i, j = np.nonzero(passed if split else np.triu(passed, 1))
    if not len(i):
        return i, j, np.zeros(0)
    shared = _pair_counts(row, at, m, split)[i, j]
    j = j + split
    union = n[i] + n[j] - shared
    value = shared / union
    ok = shared >= threshold * union - 1e-9
    return i[ok], j[ok], value[ok]


def _meet(threshold: float, orders: int):
    """Of two blocks of a cell: how many links each set has between them, and its group there by least key."""

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("rid", "ascending")])
        rid, rep, block = (table[c].to_numpy() for c in ("rid", "rep", "block"))
        sets = [_unpack(x.as_py(), 6) for x in table["grams"]]
        if table["one"][0].as_py() != table["other"][0].as_py() and block[0] == block[-1]:  # one of the two blocks is empty
            sets = []
        i, j, _ = similar(sets, threshold, orders, int(np.searchsorted(block, block[0], "right")) % len(block)) if sets else (np.zeros(0, np.int64),) * 3
        links = np.bincount(i, minlength=len(rid)) + np.bincount(j, minlength=len(rid))
        node, component = local_components(i, j)
        least = np.full(len(rid), np.iinfo(np.int64).max)
        np.minimum.at(least, component, rep[node])
        return pa.table({"rid": rid[node], "links": links[node].astype(np.int64), "a": rep[node], "b": least[component]})

    return meet


def _compared(docs: DataFrame, key: str, text: str, n: int, threshold: float, orders: int, broadcast_bytes: int) -> tuple[DataFrame, DataFrame]:
    """((h, k, rep, members, links) by key and set, edges between keys (k, a, b)) of the sets that have a partner."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folded = docs.select(docs[key].cast("long").alias("k"), F.lower(docs[text]).alias("t")).filter("k is not null and t is not null")

    sent = folded.mapInArrow(_send_texts(n, tasks, CHUNK), SENT_DDL)
    back = sent.repartitionById(tasks, F.col("r")).mapInArrow(_found_elsewhere, SENT_DDL)
    alive = written(back.repartition(tasks, "chunk").mapInArrow(_alive(threshold), "k long").distinct())
    left = folded.join(small(alive, 24, broadcast_bytes), "k", "left_semi")

    # rid is stored with the set, so it stays what it is
    sets = written(left.mapInArrow(_sets(n), "k long, grams binary").filter(F.length("grams") > 0).select(F.monotonically_increasing_id().alias("rid"), "k", F.md5("grams").alias("h"), (F.length("grams") / 6).cast("int").alias("n"), "grams"))
    keyed = written(sets.groupBy("h", "k").agg(F.min("rid").alias("rid")))
    leads = written(keyed.groupBy("h").agg(F.min("rid").alias("rid"), F.min("k").alias("rep"), F.count("*").alias("members")))
    chunks = max(1, -(-(sets.agg(F.sum("n")).first()[0] or 0) // CHUNK_SETS))
    reps = written(sets.select("rid", "n", "grams").join(small(leads.select("rid", "rep"), 40, broadcast_bytes), "rid"))

    cells = written(_cells(reps, chunks, tasks, threshold))
    sized = cells.join(reps.select("rid", "n"), "rid").groupBy("cell").agg(F.count("*").alias("texts"), F.sum("n").alias("size")).filter("texts > 1")
    blocks = sized.select("cell", F.greatest(F.ceil(F.col("texts") / BLOCK_TEXTS), F.ceil(F.col("size") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    met = (
        cells.join(blocks, "cell")
        .select("rid", "cell", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int").alias("block"), "blocks")
        .join(reps.select("rid", "rep", "grams"), "rid")
        .select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
        .select("rid", "rep", "cell", "block", "grams", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("other"))
    )
    found = written(met.groupBy("cell", "one", "other").applyInArrow(_meet(threshold, orders), "rid long, links long, a long, b long"))
    linked = found.groupBy("rid").agg(F.sum("links").alias("links"))
    info = written(leads.join(linked, "rid", "left").select("h", "rep", "members", F.coalesce("links", F.lit(0)).cast("long").alias("links")).filter("members > 1 or links > 0"))
    members = written(keyed.select("h", "k").join(info, "h"))
    edges = written(members.select("k", "rep").union(found.select("a", "b")).distinct().select(F.lit(0).alias("k"), F.col("k").alias("a"), F.col("rep").alias("b")))
    return members, edges


def similar_sets(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, orders: int = ORDERS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(key, class_id, copies, links): a row for each key that has a partner. See the module."""
    members, edges = _compared(docs, key, text, n, threshold, orders, broadcast_bytes)
    own = members.groupBy("k").agg(F.sum(F.col("members") - 1).alias("copies"), F.sum("links").alias("links")).filter("copies + links > 0")
    classes = components(edges).select(F.col("node").alias("k"), F.col("component").alias("class_id"))
    return own.join(classes, "k").select(F.col("k").alias(key), "class_id", "copies", "links")


def deduplicated(docs: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """The rows without those whose key is in a group (linked by similar sets) with a lesser key.

    Rows without a key stay, as do all rows of the least key, repeated ones too."""
    _, edges = _compared(docs, key, options.pop("text", "text"), **{"n": N, "threshold": THRESHOLD, "orders": ORDERS, "broadcast_bytes": BROADCAST_BYTES} | options)
    drop = written(components(edges).filter("node <> component").select(F.col("node").alias("drop")).distinct())
    drop = small(drop, 24, options.get("broadcast_bytes", BROADCAST_BYTES))
    return docs.join(drop, docs[key].cast("long") == drop["drop"], "left_anti")


def oracle() -> str:
    """The rows of similar_sets() with its defaults in DuckDB's SQL: all pairs of sets that share a gram, and their closure."""
    return r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), grams AS (
  SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END)) AS s FROM worded WHERE len(w) > 0
), sets AS (
  SELECT s, md5(array_to_string(s, '|')) AS h, min(doc_id) AS rep, count(DISTINCT doc_id) AS members FROM grams GROUP BY s
), entries AS (
  SELECT h, len(s) AS n, unnest(s) AS gram FROM sets
), pairs AS (
  SELECT a.h AS h, b.h AS other FROM entries a JOIN entries b ON a.gram = b.gram AND a.h <> b.h
  GROUP BY a.h, b.h HAVING 5 * count(*) >= 3 * (any_value(a.n) + any_value(b.n) - count(*))
), info AS (
  SELECT sets.h, rep, members, coalesce(l.links, 0) AS links FROM sets LEFT JOIN (SELECT h, count(*) AS links FROM pairs GROUP BY h) l ON sets.h = l.h
), members AS (
  SELECT g.doc_id, i.h, i.rep, i.members, i.links FROM grams g JOIN info i ON md5(array_to_string(g.s, '|')) = i.h
), edges AS (
  SELECT doc_id AS a, rep AS b FROM members UNION SELECT rep, doc_id FROM members
  UNION SELECT x.rep, y.rep FROM pairs JOIN sets x ON pairs.h = x.h JOIN sets y ON pairs.other = y.h
), reach(a, b) AS (
  SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
), own AS (
  SELECT doc_id, CAST(sum(members - 1) AS BIGINT) AS copies, CAST(sum(links) AS BIGINT) AS links FROM members GROUP BY doc_id
)
SELECT own.doc_id, (SELECT min(b) FROM reach WHERE reach.a = own.doc_id) AS class_id, own.copies, own.links FROM own WHERE copies + links > 0
"""
