"""Inline markers that switch rules off: as an array beside the text, or as a table for an anti join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphsieve.functions.chars import SPACE_CLASS, trimmed
from glyphsieve.functions.text import without_bom
from glyphsieve.operators.textscan import MARKER

ENTRY = "array<struct<whole:boolean,line:bigint,ids:array<string>>>"
_WORD = "^[A-Za-z0-9_.:/-]+\\z"


def entries(text: Column, file: Column, marker: str = MARKER) -> Column:
    """ENTRY: whether it holds for the whole file, or for which line, and for which rules (none: all).

    In Markdown, markers between fences are examples. At most one marker of a line counts."""
    sign = f"{marker}-disable-(file|next-line|line)([^\\r\\n]*)"
    fences = F.lower(file).rlike("\\.(?:md|markdown|mdx)\\z")
    lines = F.split(text, "\n", -1)
    plain = F.transform(lines, lambda line, i: F.struct((i + 1).cast("long").alias("n"), F.regexp_extract(line, sign, 1).alias("kind"), F.regexp_extract(line, sign, 2).alias("rest"), (fences & line.rlike(f"^[{SPACE_CLASS}]{{0,3}}(?:```|~~~)")).alias("fence")))
    # only lines that matter reach the fold
    some = F.filter(plain, lambda x: (x["kind"] != "") | x["fence"])
    kind = "struct<n:bigint,kind:string,rest:string>"
    start = F.struct(F.lit(False).alias("inside"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        keep = ~x["fence"] & ~a["inside"]
        return F.struct(
            F.when(x["fence"], ~a["inside"]).otherwise(a["inside"]).alias("inside"),
            F.when(keep, F.array_append(a["out"], F.struct(x["n"].alias("n"), x["kind"].alias("kind"), x["rest"].alias("rest")))).otherwise(a["out"]).alias("out"),
        )

    kept = F.aggregate(some, start, step, lambda a: a["out"])

    def ids(rest: Column) -> Column:
        words = F.split(trimmed(rest), f"[{SPACE_CLASS}]+")
        stop = F.array_position(F.transform(words, lambda w: w.rlike(_WORD) & (w != "-->")), F.lit(False))
        return F.when(stop == 0, words).otherwise(F.slice(words, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int")))

    return F.transform(kept, lambda x: F.struct((x["kind"] == "file").alias("whole"), (x["n"] + F.when(x["kind"] == "next-line", 1).otherwise(0)).cast("long").alias("line"), ids(x["rest"]).alias("ids")))


def silences(quiet: Column, rule: Column, line: Column) -> Column:
    """Whether an entry holds for the rule on the line."""
    return F.coalesce(F.exists(quiet, lambda e: (e["whole"] | (e["line"] == line)) & ((F.size(e["ids"]) == 0) | F.array_contains(e["ids"], rule))), F.lit(False))


def suppressions(files: DataFrame, marker: str = MARKER) -> DataFrame:
    """(file, kind, line, rule_id): kind is file or line; a null rule_id stands for every rule."""
    found = files.filter(F.col("text").contains(f"{marker}-disable-")).select("file", F.explode(entries(without_bom(F.col("text")), F.col("file"), marker)).alias("e"))
    return found.select("file", F.when(F.col("e.whole"), "file").otherwise("line").alias("kind"), F.when(~F.col("e.whole"), F.col("e.line")).alias("line"), F.explode_outer("e.ids").alias("rule_id"))


def without_suppressed(findings: DataFrame, quiet: DataFrame) -> DataFrame:
    """Findings that no row of suppressions() holds for."""
    f, s = findings.alias("f"), quiet.alias("s")
    on = (F.col("f.file") == F.col("s.file")) & (F.col("s.rule_id").isNull() | (F.col("s.rule_id") == F.col("f.rule_id"))) & ((F.col("s.kind") == "file") | (F.col("s.line") == F.col("f.line")))
    return f.join(s, on, "left_anti")
