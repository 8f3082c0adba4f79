"""Chat formatting: conversations as a prefix tree.

A turn is written as its role, a line end, its text and the end token. Conversations
that begin with the same turns share the nodes of those turns, so shared tokens are
there once. Each distinct first turn is the root of a tree, whose tokens come
depth-first as one sequence.

Each node has its tokens with position ids as if its conversation stood alone, and
the intervals of the sequence that its tokens attend to besides their own node up to
themselves: those of its ancestors, neighbours joined.

How it runs: one shuffle brings the turns of a conversation together, one makes
conversations distinct, and one sorts them by the hashes of their turns. That is a
range partitioning, so the tree of a first turn that everyone uses spreads over many
tasks. Conversations that share turns are then neighbours, and a scan with a stack
finds and tokenizes what is new in each. A task can't see what comes before its part:
it takes all of its first conversation as new and reports its first and last path and
its length. From these reports, two rows for each task, follow the true offsets,
which a last scan applies.

Result: (tree, start, end, depth, role, conversations, tokens, positions, attends):
tree is a hash of the first turn, [start, end) is the node's place in the tree's
sequence, conversations are those that end with this node.

Defined results:

* rows without a conversation id are left out;
* a null role or text counts as an empty one; a turn with an empty text is a node;
* turns come in order of turn (null first), then role, then text; repeated rows
  (same id, turn, role and text) count once;
* conversations of equal turns share all nodes, whatever the numbers of the turns;
* a turn is tokenized whole, however long; a conversation is one row of the shuffle;
* a tie in the order of turns can't be: equal turns of a conversation are one;
* other columns are not read, whatever their names; an empty table gives no rows;
* a tokenizer that can't be read, or lacks the end token, is an error at once: the driver
  reads its file and sends it along with the tasks; nothing of it need be on executors.
"""

from __future__ import annotations

import os
from base64 import b64decode
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphsieve.llm.shared import written
from glyphsieve.llm.textops import lists

#: Ranks of a byte-pair encoding, or a file of the tokenizers library (.json), which is several times slower.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = "<|endoftext|>"
#: How a text is cut before pairs are merged.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
SPANS = "array<struct<start:bigint,end:bigint>>"
NODES = f"part int, moves boolean, first int, tree bigint, start bigint, depth int, position int, role string, conversations array<bigint>, tokens array<int>, attends {SPANS}, report string, path array<binary>, lengths array<int>"
RESULT = f"tree bigint, start bigint, end bigint, depth int, role string, conversations array<bigint>, tokens array<int>, positions array<int>, attends {SPANS}"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_SPANS = pa.list_(_SPAN)
_NODES = pa.schema([("part", pa.int32()), ("moves", pa.bool_()), ("first", pa.int32()), ("tree", pa.int64()), ("start", pa.int64()), ("depth", pa.int32()), ("position", pa.int32()), ("role", pa.string()), ("conversations", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int32())), ("attends", _SPANS), ("report", pa.string()), ("path", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int32()))])

Spans = list[tuple[int, int]]


@lru_cache(maxsize=4)
def _tokenizer(file: str, end: str) -> Callable[[list[str]], list[list[int]]]:
    """From texts to their tokens and the end token's. In a text the end token's string is ordinary text.

    Ranks don't name their end token: it is the number behind the last one."""
    if file[:1] != "{":
        from tiktoken import Encoding

        ranks = {b64decode(token): int(rank) for token, rank in map(str.split, file.splitlines())}
        pairs, last = Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1
        return lambda texts: [[*pairs.encode_ordinary(t), last] for t in texts]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already use the cores
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(file)
    last = t.token_to_id(end)
    if last is None:
        raise ValueError(f"the tokenizer has no token {end}")
    t.encode_special_tokens = True
    return lambda texts: [[*x.ids, last] for x in t.encode_batch_fast(texts, add_special_tokens=False)]


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encoded(turns: list[str], file: str, end: str) -> list[list[int]]:
    """The tokens of each turn; equal turns are tokenized once."""
    known = dict.fromkeys(turns)
    for turn, tokens in zip(known, _tokenizer(file, end)(list(known)), strict=True):
        known[turn] = tokens
    return [known[turn] for turn in turns]


def encode(turns: list[str], tokenizer: str = TOKENIZER, end: str = END) -> list[list[int]]:
    return encoded(turns, read_tokenizer(tokenizer), end)


def written_turn(role: str, text: str) -> str:
    return f"{role}\n{text}"


def joined(spans: Spans, start: int, end: int) -> Spans:
    """The spans and one more; neighbours become one."""
    if start == end:
        return spans
    if spans and spans[-1][1] == start:
        return [*spans[:-1], (spans[-1][0], end)]
    return [*spans, (start, end)]


def common(one: list[bytes], other: list[bytes]) -> int:
    same = 0
    while same < len(one) and same < len(other) and one[same] == other[same]:
        same += 1
    return same


def _root(path: list[bytes]) -> int:
    return int.from_bytes(path[0][:8], "big", signed=True)


def _span_lists(flat: list[int], counts: list[int]) -> pa.ListArray:
    """Lists of spans from starts and ends one after another, and the number of spans in each list."""
    both = np.array(flat, np.int64).reshape(-1, 2)
    return lists(pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], fields=list(_SPAN)), np.array(counts, np.int64))


def _scan(tokenizer: Broadcast, end: str):
    """Nodes of sorted conversations, offsets counted from where the task's part of the tree begins.

    moves: the node's tree may have begun before this part; first: the node's depth in the part's first conversation, or -1."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: list[bytes] = []
        stack: list[tuple[int, int, int, Spans]] = []  # (start, length, position of the next turn, spans with the node) by depth
        head: dict | None = None
        part, at, moves = 0, 0, True
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("part", "path", "roles", "texts", "conversations")), strict=True))
            new, before = [], path
            for _, p, *_ in rows:
                new.append(common(before, p))
                before = p
            tokens = encoded([written_turn(r, t) for same, (_, _, roles, texts, _) in zip(new, rows, strict=True) for r, t in zip(roles[same:], texts[same:], strict=True)], tokenizer.value, end)
            ids = iter(tokens)
            out: list[tuple] = []
            attends: list[int] = []
            owners: list[int] = []
            for same, (part, p, roles, _, conversations) in zip(new, rows, strict=True):
                opening = head is None
                if same == 0 and not opening:
                    at, moves = 0, False
                del stack[same:]
                tree = _root(p)
                for depth in range(same, len(p)):
                    n = len(next(ids))
                    position, spans = (stack[-1][2], stack[-1][3]) if stack else (0, [])
                    last = depth == len(p) - 1
                    out.append((moves, depth if opening else -1, tree, at, depth, position, roles[depth], len(conversations) if last else 0, len(spans)))
                    if last:
                        owners += conversations
                    for span in spans:
                        attends += span
                    stack.append((at, n, position + n, joined(spans, at, at + n)))
                    at += n
                path = p
                if opening:
                    head = {"part": part, "report": "first", "path": p, "lengths": [n for _, n, *_ in stack]}
            if out:
                moved_, first, trees, starts, depths, positions, role, owned, spread = zip(*out, strict=True)
                flat = pa.array(np.fromiter(chain.from_iterable(tokens), np.int32))
                columns = [
                    pa.array(np.full(len(out), part, np.int32)), pa.array(moved_), pa.array(first, pa.int32()), pa.array(trees), pa.array(starts), pa.array(depths, pa.int32()), pa.array(positions, pa.int32()), pa.array(role),
                    lists(pa.array(owners, pa.int64()), np.array(owned)), lists(flat, np.array([len(x) for x in tokens])), _span_lists(attends, spread),
                    *(pa.nulls(len(out), f.type) for f in list(_NODES)[-3:]),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=_NODES)
        if head is not None:
            tail = {"part": part, "report": "last", "moves": moves, "start": at, "path": path, "lengths": [n for _, n, *_ in stack], "attends": [{"start": s, "end": s + n} for s, n, *_ in stack]}
            yield pa.RecordBatch.from_pylist([head, tail], schema=_NODES)

    return scan


def moved(spans: Spans, prefix: int, known: Spans, move: int) -> Spans:
    """Spans of a part's first tree in the tree's own offsets: what is known fills [0, prefix) of the part, the rest moves."""
    out: Spans = []
    for start, end in spans:
        begin = 0
        for s, e in known:
            low, high = max(start, begin), min(end, begin + e - s)
            if low < high:
                out = joined(out, s + low - begin, s + high - begin)
            begin += e - s
        if max(start, prefix) < end:
            out = joined(out, max(start, prefix) + move, end + move)
    return out


def carried(reports: list[dict]) -> dict[int, tuple[int, int, Spans, int]]:
    """(known turns, their length, their intervals, by how much the rest moves) for each part.

    reports: (part, report, moves, start, path, lengths, attends), two for each part, in any order."""
    by: dict[int, dict[str, dict]] = {}
    for r in reports:
        by.setdefault(r["part"], {})[r["report"]] = r
    out = {}
    path: list[bytes] = []
    stack: Spans = []
    length = 0
    for part in sorted(by):
        first, last = by[part]["first"], by[part]["last"]
        same = common(path, first["path"])
        known = stack[:same]
        prefix = sum(first["lengths"][:same])
        move = (length if same else 0) - prefix
        out[part] = (same, prefix, known, move)
        path, spans = last["path"], [(s["start"], s["end"]) for s in last["attends"]]
        if last["moves"]:
            # each turn's own interval: known ones lie in [0, prefix), at the depth that they had
            stack = [known[d] if d < same and s < prefix else (s + move, e + move) for d, (s, e) in enumerate(spans)]
            length = last["start"] + move
        else:
            stack, length = spans, last["start"]
    return out


def _finish(parts: dict[int, tuple[int, int, Spans, int]]):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, start, attends = np.ones(b.num_rows, dtype=bool), b.column("start").to_numpy().copy(), b.column("attends")
            moves = np.flatnonzero(b.column("moves").to_numpy(zero_copy_only=False).astype(bool))
            if len(moves):  # nodes of a tree that an earlier part may have begun
                part, first = (b.column(c).to_numpy() for c in ("part", "first"))
                spans = [[(s["start"], s["end"]) for s in x] for x in attends.to_pylist()]
                for i in moves:
                    same, prefix, known, move = parts[part[i]]
                    if 0 <= first[i] < same:
                        keep[i] = False  # an earlier part has it
                    else:
                        start[i] += move
                        spans[i] = moved(spans[i], prefix, known, move)
                attends = _span_lists([x for own in spans for span in own for x in span], [len(x) for x in spans])
            tokens = b.column("tokens")
            n = tokens.value_lengths().to_numpy().astype(np.int64)
            ends = np.cumsum(n)
            positions = np.arange(n.sum()) + np.repeat(b.column("position").to_numpy() - (ends - n), n)
            columns = [b.column("tree"), pa.array(start), pa.array(start + n), b.column("depth"), b.column("role"), b.column("conversations"), tokens, lists(pa.array(positions.astype(np.int32)), n), attends]
            out = pa.RecordBatch.from_arrays(columns, ["tree", "start", "end", "depth", "role", "conversations", "tokens", "positions", "attends"])
            yield out if keep.all() else out.filter(pa.array(keep))

    return finish


def prefix_tree(conversations: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tokenizer: str = TOKENIZER, end: str = END) -> DataFrame:
    """One row for each node: see the module."""
    spark = conversations.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    file = read_tokenizer(tokenizer)
    _tokenizer(file, end)
    empty = F.lit("")
    turns = conversations.select(conversations[key].cast("long").alias("k"), conversations[turn].alias("n"), F.coalesce(conversations[role].cast("string"), empty).alias("role"), F.coalesce(conversations[text].cast("string"), empty).alias("text")).filter("k is not null")
    whole = turns.groupBy("k").agg(F.array_sort(F.collect_set(F.struct("n", "role", "text"))).alias("turns"))
    hashed = whole.select("k", F.transform("turns", lambda t: F.unhex(F.md5(F.concat(t["role"], F.lit("\n"), t["text"])))).alias("path"), F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))
    # a role with a line end would write the same turn as another role and text do, and is the same node
    distinct = hashed.groupBy("path").agg(F.array_sort(F.collect_list("k")).alias("conversations"), F.any_value(F.struct("roles", "texts")).alias("one"))
    placed = distinct.repartitionByRange(tasks, "path").sortWithinPartitions("path").select(F.spark_partition_id().alias("part"), "path", "one.roles", "one.texts", "conversations")
    scanned = written(placed.mapInArrow(_scan(spark.sparkContext.broadcast(file), end), NODES))
    reports = [r.asDict(recursive=True) for r in scanned.filter("report is not null").select("part", "report", "moves", "start", "path", "lengths", "attends").collect()]
    return scanned.filter("report is null").mapInArrow(_finish(carried(reports)), RESULT)
