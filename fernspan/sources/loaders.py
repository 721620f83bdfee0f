"""Message loaders to one schema (text, label, source), role inference, registry, settings and feeds."""

from __future__ import annotations

import struct
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernspan.functions import text as T
from fernspan.session import ship

SCHEMA = "text string, label string, source string"


def _frame(df: DataFrame, text: str, label, source: str) -> DataFrame:
    d = df.select(F.col(text).cast("string").alias("text"), label.alias("label"), F.lit(source).alias("source"))
    return d.dropna(subset=["text", "label"])


def load_tsv(spark: SparkSession, path: str, source: str = "tsv") -> DataFrame:
    """label<TAB>text without header; quotes are ordinary characters; UTF-8."""
    df = spark.read.csv(path, sep="\t", header=False, quote="", escape="", schema="label string, text string", encoding="UTF-8")
    return _frame(df, "text", T.label_of(F.col("label")), source)


def load_xml(spark: SparkSession, path: str, country: str | None = "SG", label: str = "ham", source: str = "xml") -> DataFrame:
    """<message><text/><source><userProfile><country/>…: one label for all, one country or every one."""
    schema = "text string, source struct<userProfile:struct<country:string>>"
    df = spark.read.format("xml").option("rowTag", "message").schema(schema).load(path)
    if country:
        df = df.filter(F.upper(F.trim("source.userProfile.country")) == country)
    return _frame(df.filter(F.length(F.trim("text")) > 0), "text", F.lit(label), source)


def infer_roles(df: DataFrame, share: float = 0.9) -> tuple[str, str]:
    """(label column, text column): the first column whose values nearly all map to labels, and of the other string columns the longest on average; one pass."""
    names = df.columns
    one = df.agg(*(F.avg(T.label_of(F.col(c)).isNotNull().cast("double")).alias(f"m{i}") for i, c in enumerate(names)), *(F.avg(F.length(F.col(c).cast("string"))).alias(f"l{i}") for i, c in enumerate(names))).first()
    label = next((c for i, c in enumerate(names) if (one[f"m{i}"] or 0) > share), None)
    if label is None:
        raise ValueError(f"no label column; columns are {names}")
    texts = [(one[f"l{i}"] or 0.0, -i, c) for i, (c, kind) in enumerate(df.dtypes) if c != label and kind == "string"]
    if not texts:
        raise ValueError("no text column")
    return label, max(texts)[2]


def load_csv(spark: SparkSession, path: str, source: str = "csv") -> DataFrame:
    """A CSV with any header: malformed lines are skipped, roles inferred."""
    df = spark.read.csv(path, header=True, mode="DROPMALFORMED", multiLine=True, escape='"', encoding="UTF-8")
    label, text = infer_roles(df)
    return _frame(df, text, T.label_of(F.col(label)), source)


def load_all(spark: SparkSession, loaders: dict[str, Callable[[], DataFrame]], strict: bool = False) -> DataFrame:
    """The union of the sources that can be read; a missing one is an error only if strict."""
    frames = []
    for name, load in loaders.items():
        try:
            frames.append(load())
        except Exception as e:  # a missing path is Spark's AnalysisException, a missing file Python's
            if strict or "PATH_NOT_FOUND" not in str(e) and not isinstance(e, FileNotFoundError):
                raise
            spark._jvm.org.slf4j.LoggerFactory.getLogger("fernspan").info(f"source {name} is missing")
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], SCHEMA)


def require_target(df: DataFrame, target: str) -> DataFrame:
    """The frame itself, or an error before anything is written if the target class is missing."""
    if df.filter(F.col("label") == target).isEmpty():
        raise ValueError(f"no rows of the target class {target!r}")
    return df


def load_images(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("jpg", "jpeg", "png")) -> DataFrame:
    """image_rows() of a folder's files with one of the suffixes."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    suffix = F.element_at(F.split(F.element_at(F.split("path", "/"), -1), r"\."), -1)
    return image_rows(df.filter(F.lower(suffix).isin(*suffixes)).select("path", "content"))


def image_rows(files: DataFrame) -> DataFrame:
    """(path, file, cls, patient, md5, size, width, height, mode, aspect) of rows with path and content: class is the folder's name, the patient a class-specific part of the file name.

    Width, height and colour mode come from the header of a PNG (IHDR) or JPEG (start of frame), without decoding; aspect is width / height, rounded to 2.
    """
    ship(files.sparkSession)
    image_head.__annotations__ = {"content": pd.Series, "return": pd.DataFrame}  # Spark reads real types
    head = F.pandas_udf(image_head, "width int, height int, mode string")
    name, cls = F.element_at(F.split("path", "/"), -1), F.element_at(F.split("path", "/"), -2)
    patient = F.when(cls == "PNEUMONIA", F.regexp_extract(name, r"(person\d+)", 1)).otherwise(F.regexp_extract(name, r"((?:IM|NORMAL2-IM)-\d+)", 1))
    return files.select("path", name.alias("file"), cls.alias("cls"), F.nullif(patient, F.lit("")).alias("patient"), F.md5("content").alias("md5"), F.length("content").alias("size"), head("content").alias("head")).select("*", "head.*", F.round(F.col("head.width") / F.col("head.height"), 2).alias("aspect")).drop("head")


def image_head(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_head(c) for c in content], columns=["width", "height", "mode"])


def _head(c: bytes) -> tuple[int | None, int | None, str | None]:
    """(width, height, mode) of a PNG or JPEG by its header; nulls for anything else."""
    if c[:8] == b"\x89PNG\r\n\x1a\n" and len(c) >= 26:
        return *struct.unpack(">II", c[16:24]), {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.get(c[25])
    if c[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(c) and c[at] == 0xFF:
            kind, size = c[at + 1], int.from_bytes(c[at + 2 : at + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", c[at + 5 : at + 9])
                return width, height, {1: "L", 3: "RGB", 4: "CMYK"}.get(c[at + 9])
            at += 2 + size
    return None, None, None


def load_rate_feed(spark: SparkSession, path: str) -> DataFrame:
    """(rate_date, currency, eur_rate) from a feed of nested cubes: <Cube><Cube time="…"><Cube currency="…" rate="…"/></Cube></Cube>; unreadable rates are left out."""
    rate = "struct<_currency:string,_rate:string>"
    schema = f"Cube array<struct<_time:string,Cube:array<{rate}>>>"
    df = spark.read.format("xml").option("rowTag", "Cube").schema(schema).load(path)
    day = df.select(F.explode("Cube").alias("d")).select(F.col("d._time").try_cast("date").alias("rate_date"), F.explode("d.Cube").alias("c"))
    out = day.select("rate_date", F.upper(F.trim("c._currency")).alias("currency"), F.col("c._rate").try_cast("double").alias("eur_rate"))
    return out.filter("rate_date IS NOT NULL AND currency <> '' AND eur_rate IS NOT NULL")


def load_invoices(spark: SparkSession, path: str) -> DataFrame:
    """Open invoices from a CSV with header: trimmed, the currency in upper case, unreadable amounts null."""
    df = spark.read.csv(path, header=True)
    d = df.select(*(F.trim(F.col(c)).alias(c) for c in df.columns))
    return d.withColumn("currency", F.upper("currency")).withColumn("amount", F.col("amount").try_cast("double")).withColumn("due_date", F.col("due_date").try_cast("date"))
