"""Known findings: recorded once, told apart from new ones by what stands around them."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphsieve.sources.tables import kept

FILENAME = "glyphsieve-baseline.json"
VERSION = 1
ENTRIES = "file string, rule_id string, context string, ordinal int, pos int"


class BaselineError(ValueError):
    """A baseline that can't be used; never taken as an empty one."""


def keyed(findings: DataFrame) -> DataFrame:
    """Findings of a scan with its context (``internal``), with ``ordinal`` among equal ones by offset. No text is needed."""
    same = Window.partitionBy("file", "rule_id", "context").orderBy("offset")
    return findings.withColumn("ordinal", F.when(F.col("context").isNotNull(), F.row_number().over(same) - 1).otherwise(0))


def entries_for(findings: DataFrame) -> DataFrame:
    """ENTRIES without pos. Those of findings whose text isn't known have no context; they can't be written."""
    return keyed(findings).select("file", "rule_id", "context", F.col("ordinal").cast("int").alias("ordinal"))


@dataclass
class Parts:
    """New findings, known ones, and entries whose finding is gone."""

    reported: DataFrame
    baselined: DataFrame
    stale: DataFrame


def split(findings: DataFrame, baseline: DataFrame, scope: DataFrame | None = None) -> Parts:
    """First entries of the same context and ordinal, each for one finding; then, of the same file and rule, as many as are left.

    findings have their context; ``scope`` (file): the files that were scanned, if not all."""
    columns = findings.columns
    own = findings.select("file", "rule_id", "context", F.lit(None).cast("int").alias("ordinal"), F.col("offset").cast("long").alias("at"), F.lit(True).alias("own"), F.struct(*columns).alias("finding"))
    known = baseline.select("file", "rule_id", "context", F.col("ordinal").cast("int").alias("ordinal"), F.col("pos").cast("long").alias("at"), F.lit(False).alias("own"), F.lit(None).cast(own.schema["finding"].dataType).alias("finding"))
    both = own.unionByName(known).repartition("file", "rule_id")  # findings and entries meet here; no later step moves them
    both = both.withColumn("ordinal", F.when(~F.col("own"), F.col("ordinal")).when(F.col("context").isNull(), 0).otherwise(F.row_number().over(Window.partitionBy("file", "rule_id", "own", "context").orderBy("at")) - 1))
    key = ["file", "rule_id", "context", "ordinal"]
    same = Window.partitionBy(*key)
    both = both.withColumns({"nth": F.row_number().over(same.orderBy(F.desc("own"), "at")), "findings": F.count_if("own").over(same), "rows": F.count("*").over(same)})
    usable = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in key))
    # a context and ordinal are of one finding; of several entries the first is its
    exact = usable & F.when(F.col("own"), F.col("rows") > F.col("findings")).otherwise((F.col("findings") > 0) & (F.col("nth") == F.col("findings") + 1))
    both = both.select(*key, "at", "own", "finding", exact.alias("exact"))
    file = Window.partitionBy("file", "rule_id")
    left = {"more": F.count_if(~F.col("exact") & ~F.col("own")).over(file), "rest": F.count_if(~F.col("exact") & F.col("own")).over(file)}
    both = both.withColumns({"nth": F.row_number().over(Window.partitionBy("file", "rule_id", "own", "exact").orderBy("at", "context")), **left})
    counted = F.col("file").isNotNull() & F.col("rule_id").isNotNull() & (F.col("nth") <= F.when(F.col("own"), F.col("more")).otherwise(F.col("rest")))
    gone = F.col("exact") | counted
    part = F.when(F.col("own"), F.when(gone, "baselined").otherwise("reported")).when(~gone, "stale")
    parts = kept(both.select(part.alias("part"), *key, "finding").filter("part is not null"))  # read three times
    reported, baselined = (parts.filter(F.col("part") == p).select("finding.*") for p in ("reported", "baselined"))
    stale = parts.filter("part = 'stale'").select(*key)
    if scope is not None:
        stale = stale.join(scope.select("file").distinct(), "file", "left_semi")
    return Parts(reported, baselined, stale)


def pruned(baseline: DataFrame, baselined: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """The entries after a run that fixed findings: of files it covered only those that are still there."""
    rebuilt = entries_for(baselined)
    columns = ["file", "rule_id", "context", "ordinal"]
    if scope is None:
        return rebuilt.select(*columns)
    covered = scope.select("file").union(baselined.select("file")).distinct()
    return baseline.join(covered, "file", "left_anti").select(*columns).unionByName(rebuilt.select(*columns))


def serialized(rows: list[dict[str, Any]]) -> str:
    """JSON with one entry on each line, in order of file, rule, context and ordinal."""
    ordered = sorted(rows, key=lambda r: (r["file"], r["rule_id"], r["context"], r["ordinal"]))
    lines = [json.dumps({"file": r["file"], "ruleId": r["rule_id"], "context": r["context"], "ordinal": r["ordinal"]}, ensure_ascii=False, separators=(",", ":")) for r in ordered]
    body = "[\n" + ",\n".join("    " + x for x in lines) + "\n  ]" if lines else "[]"
    return f'{{\n  "version": {VERSION},\n  "entries": {body}\n}}\n'


def write(entries: DataFrame, path: str) -> None:
    """One file for people to read and compare; its rows come to the driver one by one.

    Nothing is written if an entry has no context, as its text could not be read."""
    lost = entries.filter("context is null").agg(F.count("*").alias("n"), F.min("file").alias("file")).first()
    if lost["n"]:
        raise BaselineError(f"{lost['n']} finding(s) can't be recorded, as their text can't be read; the first is in {lost['file']}")
    rows = [r.asDict() for r in entries.select("file", "rule_id", "context", "ordinal").toLocalIterator()]
    try:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(serialized(rows))
    except OSError as cause:
        raise BaselineError(f"the baseline {path} can't be written: {cause.strerror}") from cause


def parsed(text: str, path: str) -> list[dict[str, Any]]:
    try:
        value = json.loads(text)
    except ValueError as cause:
        raise BaselineError(f"the baseline {path} isn't JSON: {cause}") from cause
    if not isinstance(value, dict):
        raise BaselineError(f"the baseline {path} isn't an object")
    if value.get("version") != VERSION or isinstance(value.get("version"), bool):
        raise BaselineError(f"the baseline {path} has version {value.get('version')!r}; this engine reads version {VERSION}")
    if not isinstance(value.get("entries"), list):
        raise BaselineError(f"the baseline {path} has no list of entries")
    rows = []
    for i, e in enumerate(value["entries"]):
        if not isinstance(e, dict):
            raise BaselineError(f"entry {i} of the baseline {path} isn't an object")
        for name in ("file", "ruleId", "context"):
            if not isinstance(e.get(name), str) or not e[name]:
                raise BaselineError(f"entry {i} of the baseline {path} lacks its {name}")
        n = e.get("ordinal")
        if not isinstance(n, int) or isinstance(n, bool) or n < 0:
            raise BaselineError(f"entry {i} of the baseline {path} lacks its ordinal")
        rows.append({"file": e["file"], "rule_id": e["ruleId"], "context": e["context"], "ordinal": n, "pos": i})
    return rows


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """ENTRIES of a baseline file, or None if there is none."""
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    except FileNotFoundError:
        return None
    except OSError as cause:
        raise BaselineError(f"the baseline {path} can't be read: {cause.strerror}") from cause
    return spark.createDataFrame([tuple(r.values()) for r in parsed(text, path)], ENTRIES)
