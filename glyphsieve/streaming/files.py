"""The scan over a stream of files. It keeps no state: each file stands for itself."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from glyphsieve.operators import baseline as known
from glyphsieve.operators.scan import scan
from glyphsieve.plans.rules import Rule


def stream(spark: SparkSession, path: str, schema: str = "file string, text string", files_per_trigger: int = 64) -> DataFrame:
    """(file, text) of the Parquet files that come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def scanned(files: DataFrame, rules: list[Rule], **options: Any) -> DataFrame:
    """Findings of a stream: filters, projections and one pass over each batch of texts, so any output mode will do."""
    return scan(files, rules, **options)


def against_baseline(files: DataFrame, rules: list[Rule], baseline: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **options: Any) -> StreamingQuery:
    """Starts a query that gives each batch's new findings to ``sink``; entries of other files stay untouched."""

    def run(batch: DataFrame, number: int) -> None:
        found = scan(batch, rules, internal=True, **options)
        sink(known.split(found, baseline, batch.select("file")).reported.drop("cp_offset", "context"), number)

    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).start()
