"""Columns over whole texts."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphsieve.functions.chars import BOM, SPACE_CLASS, SPACES, trimmed

SNIFFED = 8192
CONTEXT = 40
CONTEXT_DIGITS = 12
_RUN = re.compile("[" + "".join(f"\\u{ord(c):04x}" for c in SPACES) + "]+")

_DISPUTED = re.compile("[\x1c-\x1f\x85\ufeff]")


def looks_binary(text: str) -> bool:
    return "\0" in text[:SNIFFED]


def binary(text: Column) -> Column:
    return F.substring(text, 1, SNIFFED).contains("\0")


def strip_bom(text: str) -> tuple[str, bool]:
    return (text[1:], True) if text.startswith(BOM) else (text, False)


def without_bom(text: Column) -> Column:
    return F.when(text.startswith(BOM), text.substr(F.lit(2), F.length(text))).otherwise(text)


def context_of(text: str, offset: int, length: int, plain: bool = False) -> str:
    """A short hash of what stands around a place, whatever its white space. plain: what ``is_plain`` says of the text."""
    around = text[max(0, offset - CONTEXT) : offset + length + CONTEXT]
    around = " ".join(around.split()) if plain else _RUN.sub(" ", around).strip(SPACES)
    return hashlib.sha256(around.encode("utf-8", "surrogatepass")).hexdigest()[:CONTEXT_DIGITS]


def is_plain(text: str) -> bool:
    """Whether Python's white space is JavaScript's in the text: without the few characters about which they differ."""
    return _DISPUTED.search(text) is None


def context(text: Column, offset: Column, length: Column) -> Column:
    start = F.greatest(offset - CONTEXT, F.lit(0))
    around = text.substr((start + 1).cast("int"), (offset + length + CONTEXT - start).cast("int"))
    return F.substring(F.sha2(trimmed(F.regexp_replace(around, f"[{SPACE_CLASS}]+", " ")), 256), 1, CONTEXT_DIGITS)
