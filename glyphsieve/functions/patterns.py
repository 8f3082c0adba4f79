"""Regular expressions of JavaScript's Unicode mode, for Java (Spark) and Python.

Classes become explicit lists of code points, so that white space, words, digits,
dots and ends mean the same in all three.
"""

from __future__ import annotations

import regex

from glyphsieve.functions.chars import SPACES

Ranges = list[tuple[int, int]]
LAST = 0x10FFFF
_SPACE: Ranges = [(ord(c), ord(c)) for c in SPACES]
_DIGIT: Ranges = [(48, 57)]
_WORD: Ranges = [(48, 57), (65, 90), (95, 95), (97, 122)]
_LINE_END: Ranges = [(10, 10), (13, 13), (0x2028, 0x2029)]
_CLASSES = {"s": _SPACE, "d": _DIGIT, "w": _WORD}
_CONTROL = {"n": 10, "r": 13, "t": 9, "v": 11, "f": 12, "0": 0}
_SPECIAL = frozenset("^$\\.*+?()[]{}|/")
_HEX = frozenset("0123456789abcdefABCDEF")


class PatternError(ValueError):
    """A pattern that can't be read, or that not every engine here can run."""


def escape(text: str) -> str:
    """The pattern that matches just this text."""
    return "".join("\\" + c if c in "^$\\.*+?()[]{}|" else c for c in text)


def merged(ranges: Ranges) -> Ranges:
    out: Ranges = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def complement(ranges: Ranges) -> Ranges:
    out, at = [], 0
    for low, high in merged(ranges):
        if low > at:
            out.append((at, low - 1))
        at = high + 1
    return [*out, (at, LAST)] if at <= LAST else out


class _Writer:
    """Writes what the reader found in one engine's syntax."""

    def __init__(self, java: bool):
        self.java = java

    def point(self, code: int) -> str:
        return f"\\x{{{code:X}}}" if self.java else f"\\U{code:08X}"

    def ranges(self, ranges: Ranges, properties: list[str], negative: bool) -> str:
        if negative and not properties:
            ranges, negative = complement(ranges), False
        body = "".join(self.point(a) if a == b else f"{self.point(a)}-{self.point(b)}" for a, b in merged(ranges))
        if not body and not properties:
            return "[^\\x{0}-\\x{10FFFF}]" if self.java else "(?!)"
        return f"[{'^' if negative else ''}{body}{''.join(properties)}]"

    def literal(self, code: int) -> str:
        c = chr(code)
        return c if c.isascii() and c.isalnum() else self.point(code)

    def boundary(self, inside: bool) -> str:
        w = "[0-9A-Za-z_]"
        if inside:
            return f"(?:(?<={w})(?={w})|(?<!{w})(?!{w}))"
        return f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))"

    def property(self, name: str, negative: bool) -> str:
        key, _, value = name.partition("=")
        if value:
            if key not in ("Script", "sc", "General_Category", "gc"):
                raise PatternError(f"property {name} isn't supported")
            name = ("Is" if self.java else "Script=") + value if key in ("Script", "sc") else value
        elif self.java and key in ("Alphabetic", "Uppercase", "Lowercase", "White_Space", "Ideographic", "Letter"):
            name = {"Letter": "L"}.get(key, "Is" + key)
        return f"\\{'P' if negative else 'p'}{{{name}}}"


def _code(pattern: str, i: int) -> tuple[int | None, int]:
    """(code point of the escape whose letter is at i, where it ends), or None."""
    c = pattern[i]
    if c == "x" and len(pattern) >= i + 3 and _HEX.issuperset(pattern[i + 1 : i + 3]):
        return int(pattern[i + 1 : i + 3], 16), i + 3
    if c == "u":
        if pattern[i + 1 : i + 2] == "{":
            end = pattern.find("}", i)
            digits = pattern[i + 2 : end]
            if end > 0 and digits and _HEX.issuperset(digits) and int(digits, 16) <= LAST:
                return int(digits, 16), end + 1
        elif len(pattern) >= i + 5 and _HEX.issuperset(pattern[i + 1 : i + 5]):
            high = int(pattern[i + 1 : i + 5], 16)
            if 0xD800 <= high < 0xDC00 and pattern[i + 5 : i + 7] == "\\u" and _HEX.issuperset(pattern[i + 7 : i + 11]) and len(pattern) >= i + 11:
                low = int(pattern[i + 7 : i + 11], 16)
                if 0xDC00 <= low < 0xE000:
                    return 0x10000 + ((high - 0xD800) << 10) + low - 0xDC00, i + 11
            return high, i + 5
        raise PatternError(f"bad Unicode escape in {pattern}")
    if c == "c" and pattern[i + 1 : i + 2].isascii() and pattern[i + 1 : i + 2].isalpha():
        return ord(pattern[i + 1].upper()) - 64, i + 2
    if c in _CONTROL and not (c == "0" and pattern[i + 1 : i + 2].isdigit()):
        return _CONTROL[c], i + 1
    if c in _SPECIAL or c == "-":
        return ord(c), i + 1
    return None, i


def _property(pattern: str, i: int) -> tuple[str, int]:
    end = pattern.find("}", i)
    if pattern[i + 1 : i + 2] != "{" or end < 0:
        raise PatternError(f"bad property in {pattern}")
    return pattern[i + 2 : end], end + 1


def _class(pattern: str, i: int, to: _Writer) -> tuple[str, int]:
    """A class whose bracket is at i."""
    i += 1
    negative = pattern[i : i + 1] == "^"
    i += negative
    ranges: Ranges = []
    properties: list[str] = []
    low: int | None = None  # the last single character, which may begin a range
    while True:
        if i >= len(pattern):
            raise PatternError(f"a class isn't closed in {pattern}")
        c = pattern[i]
        if c == "]":
            break
        many: Ranges | None = None
        code: int | None = None
        if c == "\\":
            if i + 1 >= len(pattern):
                raise PatternError(f"{pattern} ends with a backslash")
            e = pattern[i + 1]
            if e.lower() in _CLASSES:
                many = _CLASSES[e.lower()] if e.islower() else complement(_CLASSES[e.lower()])
                i += 2
            elif e in "pP":
                name, i = _property(pattern, i + 1)
                properties.append(to.property(name, e == "P"))
                low = None
                continue
            elif e == "b":
                code, i = 8, i + 2
            else:
                code, i = _code(pattern, i + 1)
                if code is None:
                    raise PatternError(f"bad escape \\{e} in {pattern}")
        else:
            code, i = ord(c), i + 1
        if many is not None:
            ranges += many
            low = None
            continue
        if low is not None and ranges and ranges[-1] == (low, -1):
            if code < low:
                raise PatternError(f"a range is out of order in {pattern}")
            ranges[-1] = (low, code)
            low = None
            continue
        if pattern[i : i + 1] == "-" and pattern[i + 1 : i + 2] not in ("]", "") and not (pattern[i + 1] == "\\" and pattern[i + 2 : i + 3].lower() in (*_CLASSES, "p")):
            low = code
            ranges.append((code, -1))
            i += 1
        else:
            ranges.append((code, code))
            low = None
    return to.ranges(ranges, properties, negative), i + 1


def translate(pattern: str, java: bool) -> str:
    """The pattern in Java's syntax, or in that of Python's ``regex``."""
    to = _Writer(java)
    out: list[str] = []
    i = repeats = 0
    while i < len(pattern):
        c = pattern[i]
        if c in "*+?{":
            repeats += 1
            if repeats > 1 and not (c == "?" and repeats == 2):
                raise PatternError(f"nothing to repeat in {pattern}")
        elif c != "}" and not (repeats and (c.isdigit() or c == ",") and "{" in out and "}" not in out[len(out) - 1 - out[::-1].index("{") :]):
            repeats = 0
        if c == "[":
            text, i = _class(pattern, i, to)
            out.append(text)
        elif c == ".":
            out.append(to.ranges(_LINE_END, [], True))
            i += 1
        elif c == "$":
            out.append("\\z" if java else "\\Z")
            i += 1
        elif c == "^":
            out.append("\\A")
            i += 1
        elif c == "(":
            if pattern.startswith("(?<", i) and pattern[i + 3 : i + 4] not in ("=", "!"):
                out.append("(?<" if java else "(?P<")
                i += 3
            elif pattern.startswith("(?", i) and pattern[i + 2 : i + 3] not in (":", "=", "!", "<"):
                raise PatternError(f"unknown group in {pattern}")
            else:
                out.append("(")
                i += 1
        elif c == "\\":
            if i + 1 >= len(pattern):
                raise PatternError(f"{pattern} ends with a backslash")
            e = pattern[i + 1]
            if e.lower() in _CLASSES:
                out.append(to.ranges(_CLASSES[e.lower()], [], e.isupper()))
                i += 2
            elif e in "bB":
                out.append(to.boundary(e == "B"))
                i += 2
            elif e in "pP":
                name, i = _property(pattern, i + 1)
                out.append(to.property(name, e == "P"))
            elif e in "123456789":
                out.append("\\" + e)
                i += 2
            elif e == "k" and pattern[i + 2 : i + 3] == "<":
                end = pattern.find(">", i)
                out.append(f"\\k<{pattern[i + 3 : end]}>" if java else f"(?P={pattern[i + 3 : end]})")
                i = end + 1
            else:
                code, i = _code(pattern, i + 1)
                if code is None:
                    raise PatternError(f"bad escape \\{e} in {pattern}")
                out.append(to.literal(code))
        elif c in "*+?{}|)":
            if c in "{}" and not _quantifier(pattern, i):
                raise PatternError(f"a brace stands alone in {pattern}")
            out.append(c)
            i += 1
        elif c == "]":
            raise PatternError(f"a bracket stands alone in {pattern}")
        else:
            out.append(c if c.isascii() and (c.isalnum() or c in " ,=!:<>'\"_-") else to.point(ord(c)))
            i += 1
    text = "".join(out)
    try:
        regex.compile(text if not java else translate(pattern, False), regex.V0)
    except regex.error as cause:
        raise PatternError(f"{pattern} isn't a valid expression: {cause}") from cause
    return text


def _quantifier(pattern: str, i: int) -> bool:
    start = pattern.rfind("{", 0, i + 1)
    end = pattern.find("}", start)
    body = pattern[start + 1 : end] if start >= 0 and end >= i else ""
    low, _, high = body.partition(",")
    return low.isdigit() and (not high or high.isdigit())


def for_java(pattern: str) -> str:
    return translate(pattern, True)


def for_python(pattern: str) -> regex.Pattern[str]:
    return regex.compile(translate(pattern, False), regex.V0)
