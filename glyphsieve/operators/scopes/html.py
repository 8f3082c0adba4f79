"""What a reader of a web page sees: text, some attributes, and strings of its scripts."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from glyphsieve.functions.chars import SPACES
from glyphsieve.operators.scopes.literals import Span, literals

Chunk = tuple[int, int, bool]  # start, end, whether a fix sees the chunk itself (or else its sentence)

SKIPPED = frozenset(["style", "code", "pre", "samp", "kbd", "var"])
_SCRIPTS = frozenset(["", "module", "text/javascript", "application/javascript", "text/ecmascript", "application/ecmascript"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset(["script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes"])
_FORMATTING = frozenset(["a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u"])
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
_MARKUP = re.compile(r"<!--|<!|<\?|</?[a-zA-Z]|</")
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)(\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?")
_NAME = re.compile(r"[^\s/>]+")

#: (kind, start, end, name, attributes); attributes: (name, value, whole value's span with quotes, inner span)
Attribute = tuple[str, str | None, Span, Span]
Token = tuple[str, int, int, str, list[Attribute]]


def attributes_of(text: str, at: int) -> tuple[list[Attribute], int]:
    """(attributes, where the tag ends) from behind a tag's name."""
    found: list[Attribute] = []
    n = len(text)
    while True:
        while at < n and (text[at].isspace() or text[at] == "/"):
            at += 1
        if at >= n:
            return found, n
        if text[at] == ">":
            return found, at + 1
        m = _ATTRIBUTE.match(text, at)
        group = next((g for g in (3, 4, 5) if m[g] is not None), 0)
        if m[2] is None:
            found.append((m[1], None, (m.end(), m.end()), (m.end(), m.end())))
        else:
            inner = m.span(group)
            outer = inner if group == 5 else (inner[0] - 1, m.end())
            found.append((m[1], m[group], outer, inner))
        at = m.end()


def tokens(text: str, raw: frozenset[str] = _RAW, holes: bool = False) -> Iterator[Token]:
    """Text, start and end tags and holes ({{ }}) in order; comments and declarations are left out."""
    at, begin, n = 0, 0, len(text)
    until: str | None = None  # the raw element that we are in
    while at < n:
        if until is not None:
            m = re.compile(rf"</{re.escape(until)}(?=[\s/>])", re.I).search(text, at)
            stop = m.start() if m else n
            if stop > at:
                yield "text", at, stop, until, []
            at = begin = stop
            until = None
            if m is None:
                break
        m = _MARKUP.search(text, at)
        stop = m.start() if m else n
        if holes and (hole := text.find("{{", at, stop)) >= 0:
            end = text.find("}}", hole + 2)
            if end >= 0:
                if hole > begin:
                    yield "text", begin, hole, "", []
                yield "hole", hole + 2, end, "", []
                at = begin = end + 2
                continue
        if m is None:
            break
        if stop > begin:
            yield "text", begin, stop, "", []
        sign = m[0]
        if sign == "<!--":
            end = m.end() - 2 if text.startswith("<!-->", stop) or text.startswith("<!--->", stop) else m.end()
            close = _COMMENT_END.search(text, end)
            at = close.end() if close else n
        elif sign in ("<!", "<?", "</"):
            close = text.find(">", stop)
            at = close + 1 if close >= 0 else n
        else:
            name = _NAME.match(text, m.end() - 1)
            attributes, at = attributes_of(text, name.end())
            kind = "end" if sign[1] == "/" else "start"
            yield kind, stop, at, name[0], attributes
            if kind == "start" and name[0].lower() in raw and text[at - 2 : at] != "/>" and not holes or kind == "start" and holes and name[0].lower() in ("script", "style", "textarea") and text[at - 2 : at] != "/>":
                until = name[0]
        begin = at
    if begin < n and until is None:
        yield "text", begin, n, "", []


def allowed(names: Iterable[str], tag: str, attribute: str) -> bool:
    """content counts on meta alone unless it is listed."""
    return attribute in names or (attribute == "content" and tag.lower() == "meta")


def pages_chunks(text: str, names: frozenset[str]) -> list[Chunk]:
    runs: list[list[int]] = []
    chunks: list[Chunk] = []
    open_: list[str] = []
    hidden = 0
    script: str | None = None
    for kind, start, end, name, attributes in tokens(text):
        if kind == "text":
            if name.lower() == "script":
                if script in _SCRIPTS:
                    chunks += [(start + a, start + b, True) for a, b in literals(text[start:end])]
            elif name.lower() != "style" and not hidden:
                if runs and runs[-1][1] == start:
                    runs[-1][1] = end
                else:
                    runs.append([start, end])
            continue
        tag = name.lower()
        if kind == "end":
            if tag in open_:
                i = len(open_) - 1 - open_[::-1].index(tag)
                gone = open_[i + 1 :]
                kept = [t for t in gone if t in _FORMATTING] if tag not in _FORMATTING else gone
                open_[i:] = kept
                hidden = sum(t in SKIPPED for t in open_)
            continue
        seen = set()
        for key, value, _, (a, b) in attributes:
            key = key.lower()
            if key not in seen and value is not None and b > a and allowed(names, tag, key):
                chunks.append((a, b, True))
            seen.add(key)
        if tag == "script":
            kinds = [v for k, v, *_ in attributes if k.lower() == "type"]
            script = (kinds[0] or "").strip().lower() if kinds else ""
        if tag in _ENDS_P and "p" in open_:
            i = len(open_) - 1 - open_[::-1].index("p")
            open_[i:] = [t for t in open_[i + 1 :] if t in _FORMATTING]
        if tag not in VOID and tag not in _RAW:
            open_.append(tag)
        hidden = sum(t in SKIPPED for t in open_)
    chunks += [(a, b, False) for a, b in runs if text[a:b].strip(SPACES)]
    return chunks
