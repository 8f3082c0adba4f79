"""Commit messages: what isn't the author's own text is blanked, so that places stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphsieve.functions.chars import trimmed
from glyphsieve.functions.patterns import escape

GENERATED = "^(?:Merge|Revert|fixup!|squash!|amend!)"


def _blank(line: Column) -> Column:
    return F.regexp_replace(line, "[^\\r\\n]", " ")


def masked(text: Column, comment: str = "#") -> Column:
    """struct<masked, generated>: comment lines, and all from the scissors line on, become spaces; git's own messages do as a whole."""
    lines = F.split(text, "\n", -1)
    subjects = F.filter(lines, lambda line: (F.length(trimmed(line)) > 0) & ~line.startswith(comment))
    generated = F.coalesce(trimmed(F.try_element_at(subjects, F.lit(1))).rlike(GENERATED), F.lit(False))
    scissors = f"^{escape(comment)} -{{4,}} >8 -{{4,}}"
    cut = F.array_position(F.transform(lines, lambda line: line.rlike(scissors)), F.lit(True))
    kept = F.transform(lines, lambda line, i: F.when(line.startswith(comment) | ((cut > 0) & (i + 1 >= cut)), _blank(line)).otherwise(line))
    return F.struct(F.when(generated, _blank(text)).otherwise(F.array_join(kept, "\n")).alias("masked"), generated.alias("generated"))


def prepared(messages: DataFrame, text: str = "text", comment: str = "#") -> DataFrame:
    """messages with ``text`` masked and ``generated``."""
    return messages.withColumn("m", masked(F.col(text), comment)).withColumns({text: F.col("m.masked"), "generated": F.col("m.generated")}).drop("m")
