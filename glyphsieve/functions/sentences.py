"""Sentences of prose and markup sources, and the named fix that depends on them."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass

from glyphsieve.functions.chars import CHARS, SPACES

_S = "".join(f"\\u{ord(c):04x}" for c in SPACES)
_S_INLINE = _S.replace("\\u000a", "")
_MARK = re.compile(rf"[{_S_INLINE}]*(?:<|(?:[-*+>|]|[0-9]+[.)]|#{{1,6}})[{_S_INLINE}])")
_HEAD = re.compile(rf"[{_S_INLINE}]*#{{1,6}}[{_S_INLINE}]")
_EMPTY = re.compile(rf"[{_S_INLINE}]*\Z")
_STOP = re.compile(rf"(?=([.!?;][\"'`)\]]*[{_S}]))")


def sentence_starts(text: str) -> list[int]:
    """Where sentences begin: after a stop and a blank within a line, at list items, tags, quotes and table rows, after headings and empty lines."""
    found = [0]

    def begin(at: int) -> None:
        if found[-1] < at < len(text):
            found.append(at)

    at, after_heading = 0, False
    for line in text.split("\n"):
        if _EMPTY.match(line):
            begin(at + len(line) + 1)
            after_heading = False
        else:
            if after_heading or _MARK.match(line):
                begin(at)
            after_heading = _HEAD.match(line) is not None
            for m in _STOP.finditer(line):
                begin(at + m.end(1))
        at += len(line) + 1
    return found


def sentence_at(text: str, starts: list[int], place: int) -> tuple[str, int]:
    """(the sentence around a place without white space at its ends, where it begins)."""
    i = bisect_right(starts, place) - 1
    raw = text[starts[i] : starts[i + 1] if i + 1 < len(starts) else len(text)]
    return raw.strip(SPACES), starts[i] + len(raw) - len(raw.lstrip(SPACES))


@dataclass(frozen=True)
class FixContext:
    """What a fix function gets: the match, where it stands in its container, and the rule's scope."""

    container: str
    match: str
    index: int
    scope: str


Fix = Callable[[FixContext], "str | None"]

_DASHES = CHARS["EM_DASH"] + CHARS["HORIZONTAL_BAR"]
_DASH = re.compile(f"[{_DASHES}]")
_HIDDEN = re.compile(rf"`[^`]*`|\]\([^)\n]*\)|[A-Za-z0-9_]+://[^{_S}]*|\{{[^{{}}]*\}}")
_JOINING = re.compile(r"(?:and|but|or|nor|so|yet|then|because)(?![A-Za-z0-9_])", re.I | re.A)
_BREAK = re.compile(r"\r?\n")


def _mark(c: FixContext) -> str:
    prose = _HIDDEN.sub(lambda m: " " * len(m[0]), c.container)
    dashes = [m.start() for m in _DASH.finditer(prose)]
    stop = c.index + len(c.match)
    if len(dashes) == 2 and not re.search(rf"[.!?][{_S}]", prose[dashes[0] + 1 : dashes[1]]):
        for dash, bracket in zip(dashes, "()", strict=True):
            if c.index <= dash < stop:
                return bracket
    if _JOINING.match(c.container[stop:].lstrip(SPACES)):
        return ","
    return "," if len(dashes) > 1 or ":" in prose[: c.index] else ":"


def clause_separator(c: FixContext) -> str:
    """Brackets for an aside between two dashes; else a comma before a joining word, after a colon or among several dashes; else a colon."""
    mark = _mark(c)
    dash = _DASH.search(c.match)
    sides = (c.match[dash.end() :], c.match[: dash.start()]) if dash else ("", "")
    for side in sides:
        if "\n" in side:
            line = side[_BREAK.search(side).start() :]
            return line + mark if mark == "(" else mark + line
    if mark == "(":
        return "(" if c.index == 0 else " ("
    rest = c.container[c.index + len(c.match) :]
    return mark if not rest or rest[0] in ".,;:!?)]}" or _BREAK.match(rest) else mark + " "


FIXES: dict[str, Fix] = {"clauseSeparator": clause_separator}


def is_fix_name(name: str) -> bool:
    return name in FIXES
