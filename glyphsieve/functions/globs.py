"""Path patterns: translation to regular expressions, extensions, and anonymous forms."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from glyphsieve.functions.patterns import escape

VIRTUAL = re.compile(r"<[a-z-]+>")


def to_posix(path: str) -> str:
    return path.replace("\\", "/")


def normalized(path: str) -> str:
    """A relative path with forward slashes and without a leading ./"""
    path = to_posix(path)
    while path.startswith("./"):
        path = path[2:].lstrip("/")
    return path


def relative_to_root(path: str, root: str) -> str:
    """A path as rules and baselines name it: from the root, with forward slashes."""
    return normalized(os.path.relpath(os.path.realpath(path), os.path.realpath(root)))


class GlobError(ValueError):
    """A path pattern that isn't supported."""


def alternatives(pattern: str) -> list[str]:
    """The patterns that braces stand for; a single alternative is literal text."""
    depth, start = 0, -1
    for i, c in enumerate(pattern):
        if c == "{" and (i == 0 or pattern[i - 1] != "\\"):
            if depth == 0:
                start = i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                body, parts, level, last = pattern[start + 1 : i], [], 0, 0
                for j, d in enumerate(body):
                    level += (d == "{") - (d == "}")
                    if d == "," and level == 0:
                        parts.append(body[last:j])
                        last = j + 1
                parts.append(body[last:])
                if len(parts) == 1 and (span := re.fullmatch(r"(\d+)\.\.(\d+)", body)):
                    low, high = int(span[1]), int(span[2])
                    parts = [str(n) for n in range(min(low, high), max(low, high) + 1)]
                return [x for part in parts for x in alternatives(pattern[:start] + part + pattern[i + 1 :])] if len(parts) > 1 else [pattern[:start] + "\\{" + body + "\\}" + x for x in alternatives(pattern[i + 1 :])]
    return [pattern]


def _segment(segment: str, dots: bool) -> str:
    """One path segment; a leading dot must be named unless ``dots``."""
    out, i = [], 0
    if not dots and (segment[:1] in ("*", "?", "[") or segment[:2] == "!("):
        out.append("(?!\\.)")
    while i < len(segment):
        c = segment[i]
        if c in "!@+*?" and segment[i + 1 : i + 2] == "(":
            end = segment.find(")", i)
            if end < 0:
                raise GlobError(f"a group isn't closed in {segment}")
            body = "|".join(_segment(x, True) for x in segment[i + 2 : end].split("|"))
            if c == "!":  # anything but one of these before what follows
                rest = _segment(segment[end + 1 :], True)
                return "".join(out) + f"(?!(?:{body}){rest}(?:/|\\z))[^/]*{rest}"
            out.append(f"(?:{body})" + {"@": "", "+": "+", "*": "*", "?": "?"}[c])
            i = end + 1
        elif c == "*":
            while segment[i : i + 1] == "*":
                i += 1
            out.append("[^/]*" if segment.strip("*") else "[^/]+")
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[":
            end = segment.find("]", i + 2)
            if end < 0:
                out.append("\\[")
                i += 1
                continue
            body = segment[i + 1 : end]
            negative = body[:1] in ("!", "^")
            body = body[negative:].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&").replace("^", "\\^")
            out.append(f"[{'^/' if negative else ''}{body}]")
            i = end + 1
        elif c == "\\" and i + 1 < len(segment):
            out.append(escape(segment[i + 1]))
            i += 2
        else:
            out.append(escape(c))
            i += 1
    return "".join(out)


def to_regex(pattern: str, dots: bool = False) -> str:
    """A regular expression for whole paths, the same in Java, RE2 (but for the lookaheads on dots and in negated groups) and Python.

    ``**`` stands for any directories, ``*`` and ``?`` stay inside one, and neither enters a name with a leading
    dot unless the pattern names the dot (``dots``: always)."""
    branches = []
    for one in alternatives(normalized(pattern)):
        parts = [p for i, p in enumerate(one.split("/")) if p or i == 0]
        text = ""
        for i, part in enumerate(parts):
            last = i == len(parts) - 1
            if part == "**":
                inner = "[^/]+" if dots else "(?!\\.)[^/]+"
                text += f"(?:{inner}/)*{inner}" if last else f"(?:{inner}/)*"
            else:
                text += _segment(part, dots) + ("" if last else "/")
        branches.append(text)
    return f"^(?:{'|'.join(branches)})\\z"


def any_of(patterns: list[str], dots: bool = False) -> str | None:
    """One expression for paths that any of the patterns matches."""
    return "|".join(f"(?:{to_regex(p, dots)})" for p in patterns) if patterns else None


def for_python(expression: str) -> re.Pattern[str]:
    return re.compile(expression.replace("\\z", "\\Z"))


def matches(path: str, patterns: list[str], dots: bool = False) -> bool:
    expression = any_of(patterns, dots)
    return expression is not None and for_python(expression).search(path) is not None


def extensions(pattern: str) -> list[str] | None:
    """The extensions that the pattern is about, in lower case, or None if it doesn't say."""
    if several := re.search(r"\.\{([^{}/]+)\}$", pattern):
        parts = [p.strip() for p in several[1].split(",")]
        return None if any(not p or "*" in p or "?" in p for p in parts) else ["." + p.lower() for p in parts]
    one = re.search(r"\.[A-Za-z0-9]+$", pattern)
    return [one[0].lower()] if one else None


def anonymizer() -> Callable[[str], str]:
    """A function that replaces names in patterns by dirN and fileN, the same name always by the same one."""
    known: dict[str, str] = {}

    def named(text: str, kind: str) -> str:
        return re.sub(r"[^*?{}\[\]()|!,+@]+", lambda m: known.setdefault(m[0], f"{kind}{len(known) + 1}"), text)

    def segment(text: str, kind: str) -> str:
        if text in ("", ".", "..") or re.fullmatch(r"[*?]+", text):
            return text
        lead = "." if text[0] == "." else ""
        name, dot, rest = text[len(lead) :].partition(".")
        return lead + named(name, kind) + dot + rest

    def run(pattern: str) -> str:
        if VIRTUAL.fullmatch(pattern):
            return pattern
        *directories, last = pattern.split("/")
        return "/".join([*(segment(d, "dir") for d in directories), segment(last, "file")])

    return run
