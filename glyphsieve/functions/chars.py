"""The named characters, and columns that describe characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "\ufeff"
#: name -> (code point, category, invisible)
CATALOG: dict[str, tuple[int, str, bool]] = {
    **{n: (c, "dash", False) for n, c in (("EN_DASH", 0x2013), ("EM_DASH", 0x2014), ("HORIZONTAL_BAR", 0x2015))},
    **{n: (c, "quote", False) for n, c in (("LEFT_SINGLE_QUOTE", 0x2018), ("RIGHT_SINGLE_QUOTE", 0x2019), ("LEFT_DOUBLE_QUOTE", 0x201C), ("RIGHT_DOUBLE_QUOTE", 0x201D))},
    "HORIZONTAL_ELLIPSIS": (0x2026, "punctuation", False),
    "NO_BREAK_SPACE": (0xA0, "space", False),
    "NARROW_NO_BREAK_SPACE": (0x202F, "space", False),
    **{n: (c, "zero_width", True) for n, c in (("SOFT_HYPHEN", 0xAD), ("ZERO_WIDTH_SPACE", 0x200B), ("ZERO_WIDTH_NON_JOINER", 0x200C), ("ZERO_WIDTH_JOINER", 0x200D), ("WORD_JOINER", 0x2060), ("BYTE_ORDER_MARK", 0xFEFF))},
    **{n: (0x200E + i, "bidi", True) for i, n in enumerate(("LEFT_TO_RIGHT_MARK", "RIGHT_TO_LEFT_MARK"))},
    **{n: (0x202A + i, "bidi", True) for i, n in enumerate(("LEFT_TO_RIGHT_EMBEDDING", "RIGHT_TO_LEFT_EMBEDDING", "POP_DIRECTIONAL_FORMATTING", "LEFT_TO_RIGHT_OVERRIDE", "RIGHT_TO_LEFT_OVERRIDE"))},
    **{n: (0x2066 + i, "bidi", True) for i, n in enumerate(("LEFT_TO_RIGHT_ISOLATE", "RIGHT_TO_LEFT_ISOLATE", "FIRST_STRONG_ISOLATE", "POP_DIRECTIONAL_ISOLATE"))},
}
CHARS = {name: chr(code) for name, (code, *_) in CATALOG.items()}
INVISIBLE = "".join(chr(code) for code, _, hidden in CATALOG.values() if hidden)
#: What JavaScript calls white space.
SPACES = "\t\n\v\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def escaped_class(chars: str) -> str:
    """The inside of a class of these characters, for Java and RE2."""
    return "".join(f"\\x{{{ord(c):X}}}" for c in dict.fromkeys(chars))


SPACE_CLASS = escaped_class(SPACES)


def describe(text: str) -> str:
    """U+XXXX of each code point."""
    return " ".join(f"U+{ord(c):04X}" for c in text)


def escaped(text: str) -> str:
    """The text in printable ASCII: any other UTF-16 unit as \\uXXXX, so that it survives copying."""
    units = text.encode("utf-16-be", "surrogatepass")
    codes = (units[i] << 8 | units[i + 1] for i in range(0, len(units), 2))
    return "".join(chr(c) if 0x20 <= c <= 0x7E else f"\\u{c:04x}" for c in codes)


def is_invisible(text: str) -> bool:
    return bool(text) and all(c in INVISIBLE or c in SPACES for c in text)


def described(text: Column) -> Column:
    points = F.transform(F.split(text, ""), lambda c: F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(c)), F.greatest(F.length(F.hex(F.ascii(c))), F.lit(4)), F.lit("0"))))
    return F.when(F.length(text) == 0, F.lit("")).otherwise(F.array_join(points, " "))


def invisible(text: Column) -> Column:
    return text.rlike(f"^[{SPACE_CLASS}{escaped_class(INVISIBLE)}]+\\z")


def trimmed(text: Column) -> Column:
    """Without white space at its ends, as JavaScript trims."""
    return F.regexp_replace(text, f"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+\\z", "")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return F.length(text) + F.length(F.regexp_replace(text, "[^\\x{10000}-\\x{10FFFF}]", ""))


def catalog(spark: SparkSession) -> DataFrame:
    """(name, code_point, ch, category, invisible)."""
    return spark.createDataFrame([(n, c, chr(c), k, h) for n, (c, k, h) in CATALOG.items()], "name string, code_point int, ch string, category string, invisible boolean")
