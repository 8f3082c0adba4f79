"""Scope extractors: which parts of a text a rule reads."""

from __future__ import annotations

from glyphsieve.operators.scopes.html import Chunk, pages_chunks
from glyphsieve.operators.scopes.literals import JsxError, strings_of
from glyphsieve.operators.scopes.markdown import prose_chunks
from glyphsieve.operators.scopes.markup import components_chunks
from glyphsieve.plans.rules import DEFAULT_TEXT_ATTRIBUTES, UnsupportedScopeError, scope_supports


def chunks_of(scope: str, text: str, file: str, text_attributes: tuple[str, ...] | None = None, jsx: bool = True) -> list[Chunk]:
    """(start, end, whether a fix sees the chunk itself) of what the scope reads; nothing in files it can't read."""
    names = frozenset(DEFAULT_TEXT_ATTRIBUTES if text_attributes is None else text_attributes)
    if scope == "raw":
        return [(0, len(text), False)] if text else []
    if scope not in ("strings", "html", "markdown", "markup"):
        raise UnsupportedScopeError(scope)
    if not scope_supports(scope, file):
        return []
    if scope == "strings":
        return [(a, b, True) for a, b in strings_of(text, file, jsx)]
    if scope == "html":
        return pages_chunks(text, names)
    if scope == "markdown":
        return prose_chunks(text)
    return components_chunks(text, names, file, jsx)


__all__ = ["Chunk", "JsxError", "chunks_of"]
