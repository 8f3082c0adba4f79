"""The scan of one text in Python: what Spark's own expressions can't say, and the yardstick for what they do."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import Any

import numpy as np

from glyphsieve.functions.sentences import FixContext, sentence_at, sentence_starts
from glyphsieve.functions.text import looks_binary, strip_bom
from glyphsieve.operators.scopes import chunks_of
from glyphsieve.plans.rules import Rule

MARKER = "glyphsieve"
_FENCE = re.compile(r"\s{0,3}(?:```|~~~)")
_ID = re.compile(r"[A-Za-z0-9_.:/-]+\Z")
_FENCED_FILE = re.compile(r"\.(?:md|markdown|mdx)\Z", re.I)

#: (whole file or None, line, ids): without ids it holds for every rule.
Suppression = tuple[bool, int, frozenset[str]]


def suppressions_of(text: str, file: str, marker: str = MARKER) -> list[Suppression]:
    """What the markers in a text switch off. In Markdown those in fenced blocks are examples."""
    if f"{marker}-disable-" not in text:
        return []
    sign = re.compile(rf"{re.escape(marker)}-disable-(file|next-line|line)([^\r\n]*)")
    fences, fenced, found = _FENCED_FILE.search(file) is not None, False, []
    for number, line in enumerate(text.split("\n"), 1):
        if fences and _FENCE.match(line):
            fenced = not fenced
            continue
        if not fenced and (m := sign.search(line)):
            ids = []
            for word in m[2].split():
                if not _ID.match(word) or word == "-->":
                    break
                ids.append(word)
            found.append((m[1] == "file", number + (m[1] == "next-line"), frozenset(ids)))
    return found


def suppressed(found: list[Suppression], rule: str, line: int) -> bool:
    return any((whole or at == line) and (not ids or rule in ids) for whole, at, ids in found)


class Units:
    """UTF-16 offsets of code points."""

    def __init__(self, text: str):
        self.wide = None if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else np.cumsum([0, *(1 + (c > "\uffff") for c in text)])

    def __call__(self, at: int) -> int:
        return at if self.wide is None else int(self.wide[at])


def matches_of(text: str, file: str, rules: list[Rule], *, text_attributes: tuple[str, ...] | None = None, marker: str = MARKER, jsx: bool = True) -> Iterator[tuple[Rule, int, int, str | None]]:
    """(rule, begin, end, replacement) of what rules find in a text without a byte order mark: rule by rule, places in code points."""
    chunks: dict[str, list] = {}
    breaks: list[int] | None = None
    starts: list[int] | None = None
    quiet: list[Suppression] | None = None
    for rule in rules:
        expression = rule.python
        spans = [m.span() for m in expression.finditer(text) if m.end() > m.start()]
        if not spans:
            continue
        if quiet is None:
            quiet = suppressions_of(text, file, marker)
            breaks = [m.start() for m in re.finditer("\n", text)] if quiet else []
        if rule.native and rule.positive:  # its only chunk is the whole text
            for a, b in spans:
                if not (quiet and suppressed(quiet, rule.id, bisect_left(breaks, a) + 1)):
                    yield rule, a, b, rule.fix
            continue
        if rule.scope not in chunks:
            chunks[rule.scope] = chunks_of(rule.scope, text, file, text_attributes, jsx)
        begins, ends = [a for a, _ in spans], [b for _, b in spans]
        for start, end, own in chunks[rule.scope]:
            first = bisect_right(ends, start)
            if first == len(spans) or begins[first] >= end:
                continue
            at, limit = start, len(text)
            while at <= end:
                m = expression.search(text, at, limit)
                if m is None or m.start() >= end:
                    break
                a, b = m.span()
                if a == b:
                    at = b + 1
                    continue
                if b > end:
                    limit, at = end, a  # let it match less, within the chunk
                    continue
                at = b
                if quiet and suppressed(quiet, rule.id, bisect_left(breaks, a) + 1):
                    continue
                replacement = rule.fix
                if callable(rule.fix):
                    if own:
                        container, base = text[start:end], start
                    else:
                        starts = starts if starts is not None else sentence_starts(text)
                        container, base = sentence_at(text, starts, a)
                    replacement = rule.fix(FixContext(container, m[0], a - base, rule.scope))
                yield rule, a, b, replacement


def scan_text(text: str, file: str, rules: list[Rule], *, assume_text: bool = False, text_attributes: tuple[str, ...] | None = None, marker: str = MARKER, jsx: bool = True) -> list[dict[str, Any]]:
    """Findings of one text, by offset and rule id."""
    if not rules or (not assume_text and looks_binary(text)):
        return []
    text, _ = strip_bom(text)
    if not text:
        return []
    breaks: list[int] | None = None
    units: Units | None = None
    found: list[dict[str, Any]] = []
    for rule, a, b, replacement in matches_of(text, file, rules, text_attributes=text_attributes, marker=marker, jsx=jsx):
        if breaks is None:
            breaks = [m.start() for m in re.finditer("\n", text)]
            units = Units(text)
        line, last = bisect_left(breaks, a), bisect_left(breaks, b)
        found.append(
            {
                "rule_id": rule.id,
                "file": file,
                "line": line + 1,
                "column": units(a) - units(breaks[line - 1] + 1 if line else 0) + 1,
                "end_column": units(b) - units(breaks[last - 1] + 1 if last else 0) + 1,
                "offset": units(a),
                "cp_offset": a,
                "match": text[a:b],
                "message": rule.message_for(text[a:b]),
                "severity": rule.severity,
                "fixable": replacement is not None,
                "replacement": replacement,
            }
        )
    return sorted(found, key=lambda f: (f["offset"], f["rule_id"]))
