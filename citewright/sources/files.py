"""Documents from files: text, HTML and (where a parser is installed) PDF."""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from citewright.functions.html import clean_html
from citewright.functions.text import strip

try:
    import pypdf
except ImportError:
    pypdf = None


def is_pdf(data: Column, name: Column, kind: Column) -> Column:
    return (F.substring(data, 1, 5) == F.lit(b"%PDF-")) | F.lower(F.coalesce(name, F.lit(""))).endswith(".pdf") | F.coalesce(kind, F.lit("")).contains("application/pdf")


def is_html(text: Column, name: Column, kind: Column) -> Column:
    return F.lower(F.coalesce(name, F.lit(""))).rlike("\\.html?$") | F.coalesce(kind, F.lit("")).contains("text/html") | F.substring(text, 1, 1000).rlike("(?i)<\\s*html[\\s>]|<!doctype\\s+html")


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("error", StringType())]))
def _pdf(data: pd.Series) -> pd.DataFrame:
    out = []
    for x in data:
        if x is None:
            out.append((None, None))
        elif pypdf is None:
            out.append((None, "no PDF parser is installed"))
        else:
            try:
                out.append(("\n\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(x)).pages), None))
            except Exception as e:
                out.append((None, f"unreadable PDF: {type(e).__name__}"))
    return pd.DataFrame(out, columns=["text", "error"])


@F.pandas_udf(StringType())
def _utf8(data: pd.Series) -> pd.Series:
    return data.map(lambda b: bytes(b).decode("utf-8", "replace"), na_action="ignore")


def extract_text(files: DataFrame) -> DataFrame:
    """Adds text and error to rows of data, filename and content_type. What cannot be read has an error, not an exception."""
    pdf = is_pdf(F.col("data"), F.col("filename"), F.col("content_type"))
    f = files.withColumn("is_pdf", F.coalesce(pdf, F.lit(False))).withColumn("pdf", _pdf(F.when(F.col("is_pdf"), F.col("data"))))
    f = f.withColumn("plain", _utf8(F.when(~F.col("is_pdf"), F.col("data"))))
    html = is_html(F.col("plain"), F.col("filename"), F.col("content_type"))
    text = F.when(F.col("is_pdf"), F.col("pdf.text")).when(html, clean_html(F.when(html, F.col("plain")))).otherwise(F.col("plain"))
    f = f.withColumn("text", strip(text)).withColumn("error", F.when(F.col("is_pdf"), F.col("pdf.error")))
    return f.withColumn("error", F.coalesce("error", F.when(F.coalesce("text", F.lit("")) == "", "no text"))).drop("is_pdf", "pdf", "plain")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    f = spark.read.format("binaryFile").load(path)
    return f.select(F.col("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.lit(None).cast("string").alias("content_type"), F.col("content").alias("data"))
