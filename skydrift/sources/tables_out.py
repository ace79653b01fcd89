"""Reading and writing of result tables: JSON lines, CSV with the union of columns, HTML and summaries."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html import escape
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, a missing file has none."""
    if not Path(path).exists():
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """A folder of JSON lines, one file per partition; nulls are left out."""
    df.write.mode("overwrite").json(path)


def flat(df: DataFrame) -> DataFrame:
    """Arrays and structs as JSON text, for formats without nesting."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", True).csv(path)


def write_html(df: DataFrame, path: str, title: str) -> None:
    """A folder of pages, each with a table of the rows of one batch; all rows are in them."""
    head = f"<!doctype html><title>{escape(title)}</title><table><tr>{''.join(f'<th>{escape(c)}</th>' for c in df.columns)}</tr>"

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                body = "".join("<tr>" + "".join(f"<td>{'' if v is None else escape(str(v))}</td>" for v in r) + "</tr>" for r in zip(*[c.to_pylist() for c in b.columns]))
                yield pa.RecordBatch.from_arrays([pa.array([f"{head}{body}</table>".replace("\n", " ")])], ["value"])

    flat(df).mapInArrow(pages, "value string").write.mode("overwrite").text(path)


def write_summary(path: str, values: dict) -> None:
    Path(path).write_text(json.dumps(values, indent=2, default=str), encoding="utf-8")
