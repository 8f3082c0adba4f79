"""Single-file components: texts, some attributes and the strings of expressions and scripts."""

from __future__ import annotations

import re

from glyphsieve.operators.scopes.html import Chunk, allowed, attributes_of, tokens
from glyphsieve.operators.scopes.literals import JsxError, literals

_OPEN = re.compile(r"<!--.*?(?:-->|\Z)|<([a-zA-Z][^\s/>]*)", re.S)
_BOUND = re.compile(r"(?::|v-bind:)([^\[.][^.]*)(?:\..*)?\Z")


def blocks_of(text: str) -> list[tuple[str, dict[str, str | None], int, int]]:
    """(name, attributes, start, end) of the contents of the blocks at the top."""
    found, at = [], 0
    while m := _OPEN.search(text, at):
        at = m.end()
        if m[1] is None:
            continue
        attributes, at = attributes_of(text, at)
        if text[at - 2 : at] == "/>":
            continue
        name = m[1]
        step = re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])", re.I)
        depth, start, end, after = 1, at, len(text), len(text)
        for t in step.finditer(text, at):
            if t[1]:
                depth -= 1
            elif name.lower() == "template":
                _, close = attributes_of(text, t.end())
                depth += text[close - 2 : close] != "/>"
            if depth == 0:
                end = t.start()
                close = text.find(">", t.end())
                after = close + 1 if close >= 0 else len(text)
                break
        found.append((name.lower(), {k: v for k, v, *_ in attributes}, start, end))
        at = after
    return found


def components_chunks(text: str, names: frozenset[str], file: str, jsx: bool = True) -> list[Chunk]:
    chunks: list[Chunk] = []

    def expression(start: int, end: int, elements: bool = False) -> None:
        if text[start:end].strip():
            chunks.extend((start + a, start + b, True) for a, b in literals(text[start:end], elements))

    seen = set()
    for block, given, start, end in blocks_of(text):
        kind = block + (":setup" if "setup" in given else "")
        if kind in seen:
            continue
        seen.add(kind)
        if block == "script":
            elements = given.get("lang") in ("tsx", "jsx")
            if elements and not jsx:
                raise JsxError(file)
            expression(start, end, elements)
        elif block == "template" and given.get("lang") in (None, "html"):
            inside = text[start:end]
            for token, a, b, name, attributes in tokens(inside, holes=True):
                if token == "text" and name.lower() not in ("script", "style"):
                    if inside[a:b].strip():
                        chunks.append((start + a, start + b, True))
                elif token == "hole":
                    expression(start + a, start + b)
                elif token == "start":
                    for key, value, outer, inner in attributes:
                        if value is None:
                            continue
                        if allowed(names, name, key):
                            chunks.append((start + outer[0], start + outer[1], True))
                        elif (bound := _BOUND.match(key)) and allowed(names, name, bound[1]):
                            expression(start + inner[0], start + inner[1])
    return chunks


