"""The scan of an Arrow batch of texts: expressions run text by text, everything about their matches is computed for the batch at once."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from glyphsieve.functions.text import context_of, is_plain
from glyphsieve.operators.textscan import MARKER, scan_text, suppressed, suppressions_of
from glyphsieve.plans.rules import Rule

#: What a finding may carry besides its columns.
EXTRA = {"cp_offset": pa.int64(), "context": pa.string(), "excerpt": pa.string()}
SCHEMA = pa.schema([("rule_id", pa.string()), ("file", pa.string()), *((n, pa.int64()) for n in ("line", "column", "end_column", "offset")), *((n, pa.string()) for n in ("match", "message", "severity")), ("fixable", pa.bool_()), ("replacement", pa.string())])
#: Findings in a batch that a task sends on.
MOST = 50_000
#: Bytes of text that are worked on at once: places take ten times as much, objects of Python more.
SLICE = 1 << 20


def schema(extra: tuple[str, ...] = ()) -> pa.Schema:
    return pa.schema([*SCHEMA, *((n, EXTRA[n]) for n in extra)])


def _bounds(texts: pa.Array) -> np.ndarray:
    """Where each text begins in the array's data, and where the last one ends."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch by at most SLICE bytes of text, a longer text alone. Nothing is copied."""
    if not batch.num_rows:
        return
    bounds, begin = _bounds(batch.column("text")), 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + SLICE, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


class Places:
    """Lines, columns and UTF-16 offsets in the texts of a batch, from places in code points."""

    def __init__(self, texts: pa.Array):
        data, bounds = texts.buffers()[2], _bounds(texts)
        raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        self.first = np.searchsorted(lead, bounds - bounds[0])
        signs = raw[lead]
        self.breaks = np.flatnonzero(signs == 10)
        astral = signs >= 0xF0
        self.more = np.concatenate([[0], np.cumsum(astral)]) if astral.any() else None

    def units(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """UTF-16 units between code points of the batch."""
        return end - start if self.more is None else end - start + self.more[end] - self.more[start]

    def of(self, row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """(line, column, end column, offset) of matches [begin, end) of rows."""
        first = self.first[row]
        a, b = first + begin, first + end
        before = np.searchsorted(self.breaks, first)

        def line_and_start(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n = np.searchsorted(self.breaks, at)
            return n - before, np.where(n > before, self.breaks[np.maximum(n - 1, 0)] + 1 if len(self.breaks) else first, first)

        line, start = line_and_start(a)
        _, last = line_and_start(b)
        return line + 1, self.units(start, a) + 1, self.units(last, b) + 1, self.units(first, a)


def line_at(text: str, at: int) -> str:
    """The line that a place is in."""
    start = text.rfind("\n", 0, at) + 1
    end = text.find("\n", at)
    return text[start : end if end >= 0 else len(text)].removesuffix("\r")


def plain_findings(files: list[str], texts: pa.Array, rules: list[Rule], on: np.ndarray, extra: tuple[str, ...] = (), marker: str = MARKER) -> Iterator[pa.RecordBatch]:
    """Findings of rules on whole texts whose fixes are texts. on: (rows, rules), which rule reads which text."""
    rows: list[int] = []
    which: list[int] = []
    begins: list[int] = []
    ends: list[int] = []
    matches: list[str] = []
    more: dict[str, list] = {n: [] for n in extra}
    places = None
    said: list[dict[str, str]] = [{} for _ in rules]

    def batch() -> pa.RecordBatch:
        nonlocal places
        places = places or Places(texts)
        row, begin, end = (np.array(x, np.int64) for x in (rows, begins, ends))
        line, column, end_column, offset = places.of(row, begin, end)
        found: dict[str, pa.Array] = {
            "rule_id": pa.array([r.id for r in rules], pa.string()).take(pa.array(which, pa.int32())),
            "file": pa.array(files, pa.string()).take(pa.array(row)),
            "line": pa.array(line), "column": pa.array(column), "end_column": pa.array(end_column), "offset": pa.array(offset),
            "match": pa.array(matches, pa.string()),
            "message": pa.array([said[k][m] for k, m in zip(which, matches, strict=True)], pa.string()),
            "severity": pa.array([r.severity for r in rules], pa.string()).take(pa.array(which, pa.int32())),
            "fixable": pa.array([r.fix is not None for r in rules]).take(pa.array(which, pa.int32())),
            "replacement": pa.array([r.fix for r in rules], pa.string()).take(pa.array(which, pa.int32())),
        }
        for n in extra:
            found[n] = pa.array(begin) if n == "cp_offset" else pa.array(more[n], EXTRA[n])
        own = schema(extra)
        return pa.RecordBatch.from_arrays([found[n] for n in own.names], schema=own)

    for i in np.flatnonzero(on.any(1)).tolist():
        text = texts[i].as_py()
        quiet = suppressions_of(text, files[i], marker)
        spaced = "context" in more and is_plain(text)
        for k in np.flatnonzero(on[i]).tolist():
            rule, known = rules[k], said[k]
            for m in rule.python.finditer(text):
                a, b = m.span()
                if a == b or (quiet and suppressed(quiet, rule.id, text.count("\n", 0, a) + 1)):
                    continue
                sign = m[0]
                if sign not in known:
                    known[sign] = rule.message_for(sign)
                rows.append(i)
                which.append(k)
                begins.append(a)
                ends.append(b)
                matches.append(sign)
                if "context" in more:
                    more["context"].append(context_of(text, a, b - a, spaced))
                if "excerpt" in more:
                    more["excerpt"].append(line_at(text, a))
        if len(rows) >= MOST:
            yield batch()
            for x in (rows, which, begins, ends, matches, *more.values()):
                x.clear()
            said = [{} for _ in rules]
    if rows:
        yield batch()


def scanner(rules: list[Rule], plain: list[bool], *, extra: tuple[str, ...] = (), assume_text: bool = False, text_attributes: tuple[str, ...] | None = None, marker: str = MARKER):
    """For mapInArrow over (file, text, on): one pass of all rules over each text."""
    fast = np.flatnonzero(plain)
    rest = np.flatnonzero(~np.array(plain, dtype=bool))
    own = schema(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chain.from_iterable(map(slices, batches)):
            files = b.column("file").to_pylist()
            on = b.column("on").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(rules)).astype(bool)
            if len(fast):
                yield from plain_findings(files, b.column("text"), [rules[i] for i in fast], on[:, fast], extra, marker)
            if not len(rest):
                continue
            found: list[dict] = []
            for i in np.flatnonzero(on[:, rest].any(1)).tolist():
                text = b.column("text")[i].as_py()
                try:
                    one = scan_text(text, files[i], [rules[k] for k in rest if on[i, k]], assume_text=assume_text, text_attributes=text_attributes, marker=marker)
                except ValueError as cause:
                    raise ValueError(f"{files[i]}: {cause}") from cause
                for f in one:
                    for n in extra:
                        if n != "cp_offset":
                            f[n] = context_of(text, f["cp_offset"], len(f["match"])) if n == "context" else line_at(text, f["cp_offset"])
                found += one
                if len(found) >= MOST:
                    yield pa.RecordBatch.from_pylist(found, schema=own)
                    found = []
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=own)

    return run
