"""Documents: manifests, one-document-per-file folders, metrics tables, role texts, scenario YAML, CSV samples."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from evalmart.functions.hashing import is_json_object
from evalmart.functions.text import lines_of
from evalmart.schemas import METRICS, TASK
from evalmart.sources.files import read_files, walk_files

try:
    import yaml
except ImportError:  # the key: value fallback still works
    yaml = None


def read_manifest(spark: SparkSession, path: str, task_schema: T.StructType = TASK) -> DataFrame:
    """Manifest document to task rows."""
    schema = T.StructType([T.StructField("tasks", T.ArrayType(task_schema))])
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("tasks").alias("t")).select("t.*")


def read_json_dir(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.json") -> DataFrame:
    """One document per file, its id from the file name; unreadable files are skipped."""
    raw = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    doc_id = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return raw.select(doc_id.alias("doc_id"), "value").filter(is_json_object(F.col("value"))).select(
        "doc_id", F.from_json("value", schema).alias("d")).select("doc_id", "d.*")


def read_metrics_csv(spark: SparkSession, path: str, schema: T.StructType = METRICS) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False, mode="FAILFAST")


def manifest_files(tasks: DataFrame, defaults: Mapping[str, str]) -> DataFrame:
    """(task_id, role, path): the manifest's file of each role, else the role's default name."""
    pairs = F.array(*[
        F.struct(F.lit(role).alias("role"), F.coalesce(F.col("files")[role], F.lit(name)).alias("name"))
        for role, name in defaults.items()
    ])
    return tasks.select("task_id", F.col("rel_dir"), F.explode(pairs).alias("p")).select(
        "task_id", "p.role", F.concat_ws("/", "rel_dir", "p.name").alias("path"))


def join_task_text(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """(task_id, role, text) for wanted paths; a missing file gives empty text."""
    return wanted.join(texts.select("path", "text"), "path", "left").select(
        "task_id", "role", F.coalesce("text", F.lit("")).alias("text"))


def read_task_text(spark: SparkSession, root: str, tasks: DataFrame, defaults: Mapping[str, str]) -> DataFrame:
    """Texts of the manifest's files; only files that a task names are opened."""
    wanted = manifest_files(tasks, defaults)
    files = walk_files(spark, root).join(wanted.select("path").distinct(), "path", "left_semi")
    texts = read_files(files, root, keep_content=True).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return join_task_text(wanted, texts)


def parse_scenario(df: DataFrame, text: str = "text", keys: Sequence[str] = ("name", "answer_format")) -> DataFrame:
    """Top-level scenario fields as text. A text that is no YAML mapping is read line by line as ``key: value``."""
    base = df.schema
    schema = T.StructType([*base.fields, *[T.StructField(k, T.StringType()) for k in keys]])

    def one(value: str | None) -> dict:
        found = None
        if yaml is not None and value:
            try:
                found = yaml.load(value, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
            except Exception:  # noqa: BLE001 - any malformed text goes to the fallback
                found = None
        return found if isinstance(found, dict) else fallback(value or "")

    def fallback(value: str) -> dict:
        pairs = (line.split(":", 1) for line in value.splitlines() if line[:1] not in ("", "#", " ") and ":" in line)
        return {k.strip(): v.strip().strip("'\"") for k, v in pairs}

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [one(v) for v in frame[text]]
            for k in keys:
                values = [f.get(k) for f in found]
                frame[k] = [None if v is None or str(v).strip() == "" else str(v).strip() for v in values]
            yield frame

    return df.mapInPandas(parse, schema)


def csv_cells(line: Column) -> Column:
    """Cells of one CSV line; quoted cells may hold commas and doubled quotes."""
    cells = F.regexp_extract_all(line, F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'), 1)
    return F.transform(cells, lambda c: F.when(
        c.startswith('"'), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c))


def csv_sample(text: Column, rows: int = 9, columns: int = 20, max_chars: int = 2200) -> Column:
    """Header and first data rows, first columns, cut to a length. Rows stay in line order inside the row's own array."""
    lines = F.slice(lines_of(text), 1, rows)
    cut = F.transform(lines, lambda line: F.array_join(F.slice(csv_cells(line), 1, columns), ","))
    return F.left(F.array_join(cut, "\n"), F.lit(max_chars))


def csv_columns(text: Column, columns: int = 30, max_chars: int = 900) -> Column:
    header = F.get(lines_of(text), F.lit(0))
    return F.left(F.concat(F.lit("csv columns: "), F.array_join(F.slice(csv_cells(header), 1, columns), ", ")), F.lit(max_chars))
