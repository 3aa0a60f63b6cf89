"""Sources: tables, landing folders, JSON results and configuration."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import rules


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Rows of one id; the filter reaches the scan."""
    return df.filter(F.col(key) == value)


def latest_of(df: DataFrame, key: str, value: str, order: str, newest: bool = True) -> DataFrame:
    """Per key the value at the newest (or oldest) place of the order."""
    pick = F.max_by if newest else F.min_by
    return df.groupBy(key).agg(pick(value, order).alias(value))


def newest_first(df: DataFrame, order: list[Column], limit: int, **filters) -> DataFrame:
    """Optional equality filters, newest first, limited; None means no filter."""
    for k, v in filters.items():
        if v is not None:
            df = df.filter(F.col(k) == v)
    return df.orderBy(*order).limit(limit)


def settings(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """One row with a map of all settings (a table of a few rows, kept by key)."""
    return df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("settings"))


def json_files(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """JSON files with a declared schema, and the file that each row is from."""
    reader = spark.read.schema(schema).option("multiLine", multi_line)
    return reader.json(path).withColumn("source_file", F.col("_metadata.file_path"))


def missing_jobs(models: DataFrame, variants: DataFrame, items: DataFrame, done: DataFrame) -> DataFrame:
    """The planned combinations that have no finished result.  models and variants are configuration."""
    plan = items.join(F.broadcast(models)).join(F.broadcast(variants))
    return plan.join(done.filter("error IS NULL").select(*models.columns, *variants.columns, *items.columns), [*models.columns, *variants.columns, *items.columns], "left_anti")


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a landing folder with their content, SHA-256 and sniffed format."""
    df = spark.read.format("binaryFile").load(path)
    return df.select("path", "modificationTime", "length", "content", F.sha2("content", 256).alias("sha256"), rules.sniff(F.col("content")).alias("format"))


def typed_forms(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Typed records; those without an error are approved at once."""
    return df.withColumn("errors", rules.form_errors(checks)).withColumns(
        {"entry_source": F.lit("typed"), "review_status": F.when(F.size("errors") == 0, F.lit("approved"))}
    )


def list_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    """Names of a catalogue's tables."""
    return sorted(t.name for t in spark.catalog.listTables(database))


def env_config(defaults: dict[str, str], environ: dict[str, str] | None = None) -> dict[str, str | list[str]]:
    """Defaults overridden by the environment; values with commas are lists."""
    env = os.environ if environ is None else environ
    out: dict[str, str | list[str]] = {}
    for k, v in defaults.items():
        got = env.get(k, v)
        out[k] = [x.strip() for x in got.split(",") if x.strip()] if "," in got else got
    return out


def split_statements(sql: str) -> Iterator[str]:
    """The statements of a script; semicolons in comments, quotes and dollar-quoted blocks do not count."""
    import re

    token = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|\$(\w*)\$.*?\$\1\$|;|[^;'\"$/-]+|.", re.S)
    part: list[str] = []
    for m in token.finditer(sql):
        if m[0] == ";":
            if text := "".join(part).strip():
                yield text
            part = []
        elif not m[0].startswith(("--", "/*")):
            part.append(m[0])
    if text := "".join(part).strip():
        yield text


def create_tables(spark: SparkSession, script: str, tries: int = 3) -> int:
    """Run a script statement by statement; a failed one is tried again."""
    n = 0
    for s in split_statements(script):
        for left in range(tries - 1, -1, -1):
            try:
                spark.sql(s)
                break
            except Exception:
                if not left:
                    raise
        n += 1
    return n
