"""The prose of CommonMark documents: no code, no markup, no addresses."""

from __future__ import annotations

import html.entities
import re
from dataclasses import dataclass

from glyphsieve.functions.chars import SPACES
from glyphsieve.operators.scopes.html import Chunk

_S = "".join(f"\\u{ord(c):04x}" for c in SPACES if c not in "\r\n")
_OPEN_MATTER = re.compile(r"---[ \t]*\r?\n")
_CLOSE_MATTER = re.compile(r"^(?:---|\.\.\.)[ \t]*\r?$", re.M)
_WRAP = re.compile(rf"[{_S}]*\r?\n[ \t>]*\Z")
_WRAP_BEFORE = re.compile(r"[ \t]*\r?\n[ \t>]*\Z")
_RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})\Z")
_ATX = re.compile(r"#{1,6}(?=[ \t]|\Z)")
_ATX_END = re.compile(r"(?:(?:^|[ \t]+)#+)?[ \t]*\Z")
_SETEXT = re.compile(r"(?:=+|-+)[ \t]*\Z")
_FENCE = re.compile(r"(`{3,}(?=[^`]*\Z)|~{3,})")
_BULLET = re.compile(r"[-*+](?=[ \t]|\Z)")
_NUMBER = re.compile(r"(\d{1,9})[.)](?=[ \t]|\Z)")
_BLOCKS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
).split()
_ATTRIBUTES = r"(?:\s+[a-zA-Z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*"
_TAG = rf"<[a-zA-Z][a-zA-Z0-9-]*{_ATTRIBUTES}\s*/?>|</[a-zA-Z][a-zA-Z0-9-]*\s*>"
_HTML_STARTS = (
    (re.compile(r"<(?:script|pre|style|textarea)(?:[\s>]|\Z)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![a-zA-Z]"), re.compile(r">")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"</?(?:{'|'.join(_BLOCKS)})(?:[\s>]|/>|\Z)", re.I), None),
    (re.compile(rf"(?:{_TAG})[ \t]*\Z"), None),
)
_INLINE_HTML = re.compile(rf"{_TAG}|<!-->|<!--->|<!--.*?-->|<\?.*?\?>|<![a-zA-Z].*?>|<!\[CDATA\[.*?\]\]>", re.S)
_AUTOLINK = re.compile(r"<(?:[a-zA-Z][a-zA-Z0-9+.-]{1,31}:[^\x00-\x20<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*)>", re.A)
_ENTITY = re.compile(r"&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|([A-Za-z][A-Za-z0-9]*));")
_PUNCTUATION = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_LABEL = r"\[(?:[^\[\]\\]|\\.){1,999}\]"
_DESTINATION = r"(?:<(?:[^<>\n\\]|\\.)*>|[^\s<\x00-\x1f][^\s\x00-\x1f]*)"
_TITLE = r"(?:\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|\(((?:[^()\\]|\\.)*)\))"
_DEFINITION = re.compile(rf"[ ]{{0,3}}({_LABEL}):[ \t]*\n?[ \t]*{_DESTINATION}(?:[ \t]*(?=\n|\Z)|(?:[ \t]+|[ \t]*\n[ \t]*){_TITLE}[ \t]*(?=\n|\Z))", re.S)
_DEFINITION_BARE = re.compile(rf"[ ]{{0,3}}({_LABEL}):[ \t]*\n?[ \t]*{_DESTINATION}[ \t]*(?=\n|\Z)", re.S)
_REFERENCE = re.compile(_LABEL, re.S)


@dataclass
class _Leaf:
    """A block of prose: its lines as spans of the source; block: whether a wrap may be taken in before what follows code."""

    lines: list[tuple[int, int]]
    block: bool


@dataclass
class _Container:
    quote: bool
    indent: int = 0
    bullet: str = ""


def front_matter(text: str) -> tuple[int, int, int] | None:
    """(start, end, where the document goes on) of the matter between dashes at the top."""
    if not (opening := _OPEN_MATTER.match(text)):
        return None
    closing = _CLOSE_MATTER.search(text, opening.end())
    if closing is None:
        return None
    return opening.end(), closing.start(), min(len(text), closing.end() + 1)


def _indent(text: str, at: int, end: int) -> tuple[int, int]:
    """(columns of white space, where it ends)."""
    columns = 0
    while at < end and text[at] in " \t":
        columns += 4 - columns % 4 if text[at] == "\t" else 1
        at += 1
    return columns, at


def _skip(text: str, at: int, end: int, columns: int) -> int:
    """Behind so many columns of white space (a tab counts as a whole)."""
    while at < end and columns > 0 and text[at] in " \t":
        columns -= 4 if text[at] == "\t" else 1
        at += 1
    return at


def leaves(text: str, begin: int) -> list[_Leaf]:
    """The blocks of prose in order."""
    found: list[_Leaf] = []
    containers: list[_Container] = []
    kind = ""  # paragraph, fence, html, code or nothing
    fence, fence_indent = "", 0
    ending: re.Pattern[str] | None = None
    lines: list[tuple[int, int]] = []
    depth = 0  # containers that hold the fence or html

    def close() -> None:
        nonlocal kind, lines
        if kind == "paragraph" and lines:
            found.append(_Leaf(lines, True))
        lines, kind = [], ""

    at, n = begin, len(text)
    while at < n:
        stop = text.find("\n", at)
        stop = n if stop < 0 else stop
        end = stop - 1 if stop > at and text[stop - 1] == "\r" else stop
        i, matched = at, 0
        at = stop + 1
        for c in containers:
            width, j = _indent(text, i, end)
            if c.quote:
                if width > 3 or j >= end or text[j] != ">":
                    break
                i = j + 1
                if i < end and text[i] in " \t":
                    i += 1
            elif j >= end:
                i = j
            elif width >= c.indent:
                i = _skip(text, i, end, c.indent)
            else:
                break
            matched += 1
        whole = matched == len(containers)
        if kind in ("fence", "html") and matched >= depth:
            rest = text[i:end]
            if kind == "fence":
                width, j = _indent(text, i, end)
                if width < 4 and re.fullmatch(rf"{re.escape(fence[0])}{{{len(fence)},}}[ \t]*", text[j:end]):
                    close()
            elif ending is None:
                if not rest.strip():
                    close()
            elif ending.search(rest):
                close()
            continue
        if kind in ("fence", "html"):
            close()
        was_paragraph = kind == "paragraph"
        opened = False
        while True:
            width, j = _indent(text, i, end)
            rest = text[j:end]
            if not rest or width >= 4:
                break
            if rest[0] == ">":
                if not opened:
                    close_now = containers[matched:] or was_paragraph
                    if close_now:
                        close()
                    del containers[matched:]
                containers.append(_Container(True))
                i = j + 1
                if i < end and text[i] in " \t":
                    i += 1
                opened, was_paragraph, matched = True, False, matched + 1
                continue
            if _RULE.match(rest) and not (was_paragraph and whole and not opened and _SETEXT.match(rest)):
                break
            bullet = _BULLET.match(rest) or _NUMBER.match(rest)
            if not bullet:
                break
            empty = not rest[bullet.end() :].strip()
            number = bullet[1] if bullet.re is _NUMBER else None
            if was_paragraph and whole and not opened and (empty or (number is not None and int(number) != 1)):
                break
            close()
            if not opened:
                del containers[matched:]
            marker = bullet.end()
            gap, k = _indent(text, j + marker, end)
            if empty:
                space, k = 1, end
            elif gap > 4:
                space, k = 1, j + marker + 1
            else:
                space = gap
            containers.append(_Container(False, width + marker + space))
            i, opened, was_paragraph, matched = k, True, False, matched + 1
        width, j = _indent(text, i, end)
        rest = text[j:end].rstrip(" \t")
        lazy = kind == "paragraph" and not opened and not whole
        if not rest:
            close()
            if not whole and not opened:
                del containers[matched:]
            continue
        if kind == "paragraph" and not opened and whole and width < 4 and _SETEXT.match(rest):
            found.append(_Leaf(lines, True))
            lines, kind = [], ""
            continue
        if width >= 4:
            if kind == "paragraph" and not opened:
                lines.append((j, j + len(rest)))
                continue
            if not whole and not opened:
                del containers[matched:]
            close()
            kind = "code"
            continue
        start_html = next((x for x in _HTML_STARTS[: 6 if kind == "paragraph" and not opened else 7] if x[0].match(rest)), None)
        mark = _FENCE.match(rest)
        heading = _ATX.match(rest)
        if start_html or mark or heading or _RULE.match(rest):
            if not opened:
                del containers[matched:]
            close()
            if heading:
                a = j + heading.end()
                body = text[a : j + len(rest)]
                body = body[: _ATX_END.search(body).start()]
                lead = len(body) - len(body.lstrip(" \t"))
                if body.strip():
                    found.append(_Leaf([(a + lead, a + len(body.rstrip(" \t")))], False))
            elif mark:
                kind, fence, depth = "fence", mark[1], len(containers)
            elif start_html:
                ending, depth = start_html[1], len(containers)
                first = start_html[0].match(rest)
                if ending is None or not ending.search(rest, first.end() if start_html is not _HTML_STARTS[1] else 4):
                    kind = "html"
            continue
        if kind != "paragraph":
            close()
            kind = "paragraph"
        if not lazy and not whole and not opened:
            del containers[matched:]
        lines.append((j, j + len(rest)))
    close()
    return found


class _Inline:
    """Which characters of a block are prose. The block's lines are joined by line ends."""

    def __init__(self, text: str, lines: list[tuple[int, int]]):
        self.text = "\n".join(text[a:b] for a, b in lines)
        self.place: list[int] = []
        for a, b in lines:
            self.place += [*range(a, b), b]
        self.data = bytearray(b"\1" * len(self.text))

    def hide(self, a: int, b: int) -> None:
        self.data[a:b] = bytes(b - a)

    def definitions(self) -> tuple[set[str], int]:
        """(labels defined at the beginning, where they end); their titles stay prose."""
        labels, at = set(), 0
        while m := _DEFINITION.match(self.text, at) or _DEFINITION_BARE.match(self.text, at):
            if not m[1][1:-1].strip():
                break
            labels.add(_normal(m[1]))
            keep = next(((m.start(g), m.end(g)) for g in (2, 3, 4) if m.re is _DEFINITION and m[g] is not None), None)
            self.hide(m.start(), keep[0] if keep else m.end())
            if keep:
                self.hide(keep[1], m.end())
                self.escapes(*keep)
            at = m.end() + 1
            if at > len(self.text):
                break
        return labels, min(at, len(self.text))

    def escapes(self, a: int, b: int) -> None:
        """Hides line ends, escapes and references in a span that is text otherwise."""
        i = a
        while i < b:
            c = self.text[i]
            if c == "\\" and self.text[i + 1 : i + 2] in _PUNCTUATION and i + 1 < b:
                self.hide(i, i + 2)
                i += 2
                continue
            if c == "&" and (m := _entity(self.text, i)):
                self.hide(i, m)
                i = m
                continue
            if c == "\n":
                self.hide(i, i + 1)
            i += 1

    def run(self, at: int, defined: set[str]) -> None:
        text, n = self.text, len(self.text)
        brackets: list[tuple[int, bool, int]] = []  # (place, image, delimiters so far)
        delimiters: list[list] = []  # [place, length, sign, opens, closes, original length]
        inactive = -1  # brackets below this index can't make links any more
        i = at
        while i < n:
            c = text[i]
            if c == "\\":
                if i + 1 < n and text[i + 1] in _PUNCTUATION:
                    self.hide(i, i + 2)
                    i += 2
                    continue
                if text[i + 1 : i + 2] == "\n":
                    self.hide(i, i + 1)
            elif c == "\n":
                self.hide(i, i + 1)
            elif c == "`":
                length = len(re.compile("`+").match(text, i)[0])
                close = re.compile(rf"(?<!`)`{{{length}}}(?!`)").search(text, i + length)
                if close:
                    self.hide(i, close.end())
                    i = close.end()
                else:
                    i += length
                continue
            elif c == "<":
                if m := _AUTOLINK.match(text, i) or _INLINE_HTML.match(text, i):
                    self.hide(i, m.end())
                    i = m.end()
                    continue
            elif c == "&":
                if m := _entity(text, i):
                    self.hide(i, m)
                    i = m
                    continue
            elif c in "*_":
                length = len(re.compile(re.escape(c) + "+").match(text, i)[0])
                before, after = text[i - 1 : i] or " ", text[i + length : i + length + 1] or " "
                left = not after.isspace() and (not _punct(after) or before.isspace() or _punct(before))
                right = not before.isspace() and (not _punct(before) or after.isspace() or _punct(after))
                opens = left and (c == "*" or not right or _punct(before))
                closes = right and (c == "*" or not left or _punct(after))
                delimiters.append([i, length, c, opens, closes, length])
                i += length
                continue
            elif c == "!" and text[i + 1 : i + 2] == "[":
                brackets.append((i, True, len(delimiters)))
                i += 2
                continue
            elif c == "[":
                brackets.append((i, False, len(delimiters)))
            elif c == "]" and brackets:
                start, image, level = brackets.pop()
                opening = start + 1 + image
                active = image or len(brackets) > inactive
                target = self.target(i, opening, defined) if active else None
                if target is not None:
                    self.hide(start, opening)
                    self.hide(i, i + 1)
                    keep, end = target
                    self.hide(i + 1, keep[0] if keep else end)
                    if keep:
                        self.hide(keep[1], end)
                        self.escapes(*keep)
                    self.emphasize(delimiters, level)
                    if not image:
                        inactive = len(brackets) - 1
                    i = end
                    continue
                if len(brackets) <= inactive:
                    inactive = len(brackets) - 1
            i += 1
        self.emphasize(delimiters, 0)

    def target(self, close: int, opening: int, defined: set[str]) -> tuple[tuple[int, int] | None, int] | None:
        """(the title's span or None, where the link ends) of what follows a bracket."""
        text = self.text
        if text[close + 1 : close + 2] == "(" and (found := _resource(text, close + 2)):
            return found
        if (m := _REFERENCE.match(text, close + 1)) and _normal(m[0]) in defined:
            return None, m.end()
        label = _normal(text[opening - 1 : close + 1])
        if label in defined:
            return None, close + (3 if text.startswith("[]", close + 1) else 1)
        return None

    def emphasize(self, delimiters: list[list], level: int) -> None:
        """Hides the signs that pair; drops those from the level on."""
        own = delimiters[level:]
        del delimiters[level:]
        k = 0
        while k < len(own):
            closer = own[k]
            if not closer[4] or not closer[1]:
                k += 1
                continue
            for o in range(k - 1, -1, -1):
                opener = own[o]
                if opener[2] == closer[2] and opener[3] and opener[1] and not ((opener[4] or closer[3]) and (opener[5] + closer[5]) % 3 == 0 and (opener[5] % 3 or closer[5] % 3)):
                    use = 2 if opener[1] > 1 and closer[1] > 1 else 1
                    opener[1] -= use
                    self.hide(opener[0] + opener[1], opener[0] + opener[1] + use)
                    self.hide(closer[0], closer[0] + use)
                    closer[0] += use
                    closer[1] -= use
                    for x in own[o + 1 : k]:
                        x[1] = 0
                    break
            else:
                k += 1
                continue
            if not closer[1]:
                k += 1

    def spans(self) -> list[tuple[int, int]]:
        out = []
        for m in re.finditer(b"\1+", self.data):
            out.append((self.place[m.start()], self.place[m.end() - 1] + 1))
        return out


def _punct(c: str) -> bool:
    return c in _PUNCTUATION or (not c.isascii() and not c.isalnum() and not c.isspace())


def _entity(text: str, i: int) -> int | None:
    m = _ENTITY.match(text, i)
    return m.end() if m and (m[1] is None or m[1] + ";" in html.entities.html5) else None


def _normal(label: str) -> str:
    return " ".join(label[1:-1].split()).casefold()


def _resource(text: str, i: int) -> tuple[tuple[int, int] | None, int] | None:
    blank = re.compile(r"[ \t]*\n?[ \t]*")
    i = blank.match(text, i).end()
    if text[i : i + 1] == ")":
        return None, i + 1
    if text[i : i + 1] == "<":
        m = re.compile(r"<(?:[^<>\n\\]|\\.)*>").match(text, i)
        if not m:
            return None
        i = m.end()
    else:
        depth = 0
        while i < len(text) and text[i] > " ":
            if text[i] == "\\" and text[i + 1 : i + 2] in _PUNCTUATION:
                i += 1
            elif text[i] == "(":
                depth += 1
            elif text[i] == ")":
                if depth == 0:
                    break
                depth -= 1
            i += 1
        if depth:
            return None
    after = blank.match(text, i).end()
    if text[after : after + 1] == ")":
        return None, after + 1
    if after == i:
        return None
    m = re.compile(_TITLE, re.S).match(text, after)
    if not m:
        return None
    end = blank.match(text, m.end()).end()
    if text[end : end + 1] != ")":
        return None
    group = next(g for g in (1, 2, 3) if m[g] is not None)
    return m.span(group), end + 1


def prose_chunks(text: str) -> list[Chunk]:
    matter = front_matter(text)
    found: list[tuple[int, int, int]] = []  # start, end, where its block begins
    if matter and matter[1] > matter[0]:
        found.append((matter[0], matter[1], matter[0]))
    blocks = [(leaf, _Inline(text, leaf.lines)) for leaf in leaves(text, matter[2] if matter else 0)]
    defined: set[str] = set()
    bodies = []
    for leaf, inline in blocks:
        labels, at = inline.definitions() if leaf.block else (set(), 0)
        defined |= labels
        bodies.append(at)
    for (leaf, inline), at in zip(blocks, bodies, strict=True):
        inline.run(at, defined)
        found += [(a, b, leaf.lines[0][0] if leaf.block else a) for a, b in inline.spans()]
    chunks: list[list[int]] = []
    for start, end, block in found:
        if chunks and _WRAP.match(text[chunks[-1][1] : start]):
            chunks[-1][1] = end
            continue
        floor = max(block, chunks[-1][1] if chunks else 0)
        if wrap := _WRAP_BEFORE.search(text[floor:start]):
            start = floor + wrap.start()
        chunks.append([start, end])
    return [(a, b, False) for a, b in chunks]
