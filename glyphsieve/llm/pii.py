"""Personal data and secrets: expressions propose, checksums confirm, context adjusts.

Each kind has an expression, a base score and, where there is one, a validator:
Luhn for card numbers, mod-97 and the length that its country has for IBANs, ranges
for IPv4 addresses and social security numbers. A span whose validator fails is
dropped. Whole words of the kind within ``NEAR`` characters of a span raise its score,
words that speak against it lower it; a word that is only partly that near doesn't
count. Spans that reach ``min_score`` are reported.

Defined results:

* null and empty texts have no spans; a null stays null when masked; a null key's
  spans are reported with it;
* of overlapping spans the one with the higher score stays, then the longer, then
  the first, then the kind that sorts first;
* positions are characters of the text; repeated rows each get their spans;
* very long texts are read whole;
* a value behind a key's name runs to the closing quote or the next blank, however
  long; signs (& % $ # *) at the end of one without quotes don't belong to it. Behind
  a colon a value without quotes must be unlike a word: a digit, a sign or a capital
  within it, or more than 3.5 bits of entropy a letter;
* an IBAN ends where its country's length says; what follows doesn't matter unless it
  is a letter or digit;
* other columns are not read, whatever their names (masked documents keep them); an
  empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphsieve.llm.textops import buffers, lists

MIN_SCORE = 0.5
NEAR = 40
SPANS = "array<struct<kind:string,start:int,end:int,score:double,checked:boolean>>"
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("checked", pa.bool_())])


def luhn(text: str) -> bool:
    """Whether the digits of the text pass the Luhn check and aren't all the same."""
    digits = [ord(c) - 48 for c in text if "0" <= c <= "9"]
    if not 12 <= len(digits) <= 19 or len(set(digits)) == 1:
        return False
    twice = (2 * d - 9 * (d > 4) for d in digits[-2::-2])
    return (sum(digits[-1::-2]) + sum(twice)) % 10 == 0


#: How long the IBANs of each country are.
IBAN_LENGTHS = {
    c: int(n)
    for n, countries in {
        "15": "NO", "16": "BE", "18": "DK FI FK FO GL NL SD", "19": "MK SI", "20": "AT BA EE KZ LT LU XK",
        "21": "CH HR LI LV", "22": "BG BH CR DE GB GE IE ME RS VA", "23": "AE GI IL IQ OM SO TL",
        "24": "AD CZ ES MD PK RO SA SE SK TN VG", "25": "LY PT ST", "26": "IS TR",
        "27": "BI DJ FR GR IT MC MR SM", "28": "AL AZ BY CY DO GT HN HU LB NI PL SV", "29": "BR EG PS QA UA",
        "30": "JO KW MU YE", "31": "MT SC", "32": "LC", "33": "RU",
    }.items()
    for c in countries.split()
}


def mod97(text: str) -> bool:
    """Whether the text is an IBAN of its country's length with right check digits."""
    code = text.replace(" ", "").upper()
    if len(code) != IBAN_LENGTHS.get(code[:2]):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def iban_end(text: str, start: int, end: int) -> int:
    """Where the IBAN that begins at start must end by its country's length: at end at the latest, or at start (none)."""
    left = IBAN_LENGTHS.get(text[start : start + 2], 0)
    for i in range(start, end if left else start):
        left -= text[i] != " "
        if not left:
            return i + 1 if i + 1 == len(text) or not (text[i + 1].isascii() and text[i + 1].isalnum()) else start
    return start


def unlike_a_word(text: str) -> bool:
    """Whether what a colon is followed by may be a secret: anything quoted or assigned is."""
    m = _ASSIGNED.match(text)
    if not m or m[1] == "=" or text[m.end()] in "\"'":
        return True
    value = text[m.end() :]
    if re.search(r"[\d]|[^\W\d_].*[^\w.,;:!?].*\w|[a-z].*[A-Z]", value):
        return True
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values()) > 3.5


def ipv4(text: str) -> bool:
    parts = text.split(".")
    return all(int(p) < 256 and str(int(p)) == p for p in parts) and parts[0] != "0"


def ssn(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: re.Pattern[str]
    base: float
    check: Callable[[str], bool] | None = None
    words: re.Pattern[str] | None = None
    against: re.Pattern[str] | None = None
    ends: Callable[[str, int, int], int] | None = None
    plausible: Callable[[str], bool] | None = None


def _any(words: str) -> re.Pattern[str]:
    return re.compile(rf"(?<![^\W_])(?:{words})(?![^\W_])")


KINDS = (
    Kind("EMAIL", re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"), 0.9, None, _any("e-?mail|mail|contact|write|courriel|correo")),
    Kind("CARD", re.compile(r"(?<![\w.,/-])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5}|\d{13,19})(?![\w/]|[.,-]\d)", re.A), 0.75, luhn, _any("card|credit|visa|mastercard|amex|payment|karte|carte|tarjeta|cvv|cvc"), _any("isbn|order|invoice|serial|tracking")),
    Kind("IBAN", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}", re.A), 0.8, mod97, _any("iban|account|bank|konto|compte|cuenta|bic|swift"), None, iban_end),
    Kind("PHONE", re.compile(r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?![\w-])", re.A), 0.65, None, _any("tel|telephone|telefon|telefono|phone|call|mobile|cell|fax|ring|anrufen|appelez"), _any("isbn|order|invoice|serial|version")),
    Kind("IPV4", re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", re.A), 0.6, ipv4, _any("ip|address|host|server|client|login|from"), _any("version|release|section|build|v")),
    Kind("SSN", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.A), 0.5, ssn, _any("ssn|social|security")),
    Kind("SECRET", re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,})(?![A-Za-z0-9])|(?i:(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key))\s{0,3}[=:]\s{0,3}(?:\"[^\s\"]{8,}\"|'[^\s']{8,}'|[\"']?(?:[^\s\"']|[\"'](?=\w)){7,}[^\s\"'&%$#*][\"']?)"), 0.8, None, _any("key|token|secret|password|credential|aws"), None, None, unlike_a_word),
)

_ASSIGNED = re.compile(r"[A-Za-z_-]+\s{0,3}([=:])\s{0,3}")
_LETTERS = re.compile(r"[^\W_]+")
_TAIL = re.compile(r"[^\W_]*\Z")

#: A span of any kind holds one of these bytes, or the letters of a key's mark.
_TRIGGER = np.zeros(256, dtype=bool)
_TRIGGER[[*range(48, 58), ord("@"), ord("="), ord(":")]] = True
_MARKS = re.compile(rb"AKIA|gh[pousr]_|sk-")


def spans_of(kind: Kind, text: str) -> Iterator[tuple[int, int]]:
    """What the kind's expression proposes and its validators confirm."""
    at = 0
    while m := kind.pattern.search(text, at):
        start, end = m.span()
        if kind.ends:
            end = kind.ends(text, start, end)
        if end > start and (kind.check is None or kind.check(text[start:end])) and (kind.plausible is None or kind.plausible(text[start:end])):
            yield start, end
            at = end
        else:
            at = start + 4 if kind.ends else m.end()  # behind a wrong country a right one may begin


def around(text: str, start: int, end: int) -> str:
    """The whole words within NEAR characters before and after a span."""
    low, high = max(0, start - NEAR), min(len(text), end + NEAR)
    left, right = text[low:start], text[end:high]
    if low and _LETTERS.match(text[low - 1]) and (m := _LETTERS.match(left)):
        left = left[m.end() :]
    if high < len(text) and _LETTERS.match(text[high]):
        right = right[: len(right) - len(_TAIL.search(right)[0])]
    return left.lower() + "\n" + right.lower()


def find(text: str, min_score: float = MIN_SCORE) -> list[tuple[int, int, str, float, bool]]:
    """(start, end, kind, score, checked) of the spans of a text, in order."""
    found = []
    for kind in KINDS:
        for start, end in spans_of(kind, text):
            score = kind.base + (0.15 if kind.check else 0)
            near = around(text, start, end)
            if kind.words and kind.words.search(near):
                score += 0.2
            if kind.against and kind.against.search(near):
                score -= 0.3
            score = round(min(1.0, max(0.0, score)), 2)
            if score >= min_score:
                found.append((start, end, kind.name, score, kind.check is not None))
    if len(found) > 1:
        taken: list[tuple[int, int, str, float, bool]] = []
        free = np.ones(max(x[1] for x in found), dtype=bool)
        for x in sorted(found, key=lambda x: (-x[3], x[0] - x[1], x[0], x[2])):
            if free[x[0] : x[1]].all():
                free[x[0] : x[1]] = False
                taken.append(x)
        found = taken
    return sorted(found)


def _triggered(texts: pa.Array) -> np.ndarray:
    """Rows that may hold a span."""
    data, offsets = buffers(texts)
    at = np.flatnonzero(_TRIGGER[data])
    marks = [m.start() for m in _MARKS.finditer(data.tobytes())]
    return np.unique(np.searchsorted(offsets, np.concatenate([at, np.array(marks, np.int64)]), side="right") - 1)


def finder(min_score: float = MIN_SCORE):
    """An Arrow UDF from a text to its SPANS."""

    @F.arrow_udf(SPANS)
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            counts, found = np.zeros(len(texts), np.int64), []
            for i in _triggered(texts):
                one = find(texts[int(i)].as_py(), min_score)
                counts[i] = len(one)
                found += one
            start, end, kind, score, checked = zip(*found, strict=True) if found else ((),) * 5
            values = pa.StructArray.from_arrays([pa.array(kind, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(score, pa.float64()), pa.array(checked, pa.bool_())], fields=list(SPAN))
            yield lists(values, counts)

    return spans


def masker(min_score: float = MIN_SCORE):
    """An Arrow UDF from a text to the text with [KIND] for each span."""

    @F.arrow_udf("string")
    def mask(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            changed: list[str] = []
            where = np.zeros(len(texts), dtype=bool)
            for i in _triggered(texts):
                text = texts[int(i)].as_py()
                if one := find(text, min_score):
                    parts, at = [], 0
                    for start, end, kind, *_ in one:
                        parts += [text[at:start], f"[{kind}]"]
                        at = end
                    changed.append("".join([*parts, text[at:]]))
                    where[i] = True
            yield pa.compute.replace_with_mask(texts, pa.array(where), pa.array(changed, texts.type)) if changed else texts

    return mask


def private_spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """(key, kind, start, end, score, checked): one row for each span."""
    found = docs.select(docs[key].alias("k"), F.explode(finder(min_score)(docs[text])).alias("s"))
    return found.select(F.col("k").alias(key), "s.*")


def masked(text: Column, min_score: float = MIN_SCORE) -> Column:
    return masker(min_score)(text)


def masked_documents(docs: DataFrame, *, text: str = "text", size: str = "n_chars", min_score: float = MIN_SCORE) -> DataFrame:
    """All rows and columns of docs with the text masked; a column that holds the text's length is renewed (null stays null)."""
    out = docs.select(*(masked(docs[c], min_score).alias(c) if c == text else docs[c] for c in docs.columns))
    if size not in docs.columns:
        return out
    return out.select(*(F.when(out[size].isNotNull(), F.length(out[text])).cast(docs.schema[size].dataType).alias(c) if c == size else out[c] for c in out.columns))
