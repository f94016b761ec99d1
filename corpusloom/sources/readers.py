"""Readers.  Every raw file is read as text columns with an explicit schema; nothing is inferred."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORDS = "map<string, struct<annotators: array<struct<label: string>>, post_tokens: array<string>>>"
PAGE = "page_id bigint, url string, fetched_at string, status int, n_blocks int, blocks array<string>"


def csv_header(path: str, sep: str = ",", encoding: str = "utf-8") -> list[str]:
    with open(path, encoding="utf-8-sig" if encoding.lower() in ("utf-8", "utf8", "utf-8-sig") else encoding, newline="") as f:
        return next(csv.reader(f, delimiter=sep))


def strings_csv(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str], sep: str = ",", encoding: str = "utf-8") -> DataFrame:
    """CSV members with a header, all columns as text: "NA" stays "NA", an empty field is the empty text, quoted line breaks hold."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("sep", sep)
    df = reader.option("encoding", "UTF-8" if encoding.lower().startswith("utf") else encoding).option("nullValue", "\x00").option("emptyValue", "").csv(paths if isinstance(paths, str) else list(paths))
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns])


def raw_csv(spark: SparkSession, root: str, source: str, member: str, encoding: str = "utf-8", sep: str = ",") -> DataFrame:
    """A member of a source below the root folder, with the columns of its own header."""
    path = os.path.join(root, source, member)
    return strings_csv(spark, path, csv_header(path, sep, encoding), sep, encoding)


def union_members(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """(post_id, labels, text) of a JSON map from post to annotations and tokens."""
    raw = spark.read.option("wholetext", True).text(path).select(F.from_json("value", RECORDS).alias("m"))
    return raw.select(F.explode("m").alias("post_id", "r")).select("post_id", F.transform("r.annotators", lambda a: a["label"]).alias("labels"), F.array_join("r.post_tokens", " ").alias("text"))


def json_documents(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Whole JSON documents, one row each, with the name of the file."""
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema else reader).json(path)
    return df.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE).json(path)


def lexicon_tsv(spark: SparkSession, path: str) -> DataFrame:
    return strings_csv(spark, path, ["lemma", "category", "level"], sep="\t")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url, note) of a tab-separated list; lines that start with # and blank ones are left out."""
    lines = spark.read.text(path).where("trim(value) <> '' and not ltrim(value) like '#%'")
    return lines.select(F.trim(F.split("value", "\t")[0]).alias("url"), F.trim(F.get(F.split("value", "\t"), F.lit(1))).alias("note"))


def zip_members(spark: SparkSession, path: str, names: Sequence[str], known: DataFrame | None = None) -> DataFrame:
    """(archive, member, content, sha256) of the named members of zip archives; a wanted member that is absent has null content.

    known: (sha256) of archives that were extracted before; they are left out.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    have = set(z.namelist())
                    data = [z.read(n) if n in have else None for n in names]
                digest = hashlib.sha256(raw).hexdigest()
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(names)), pa.array(list(names)), pa.array(data, pa.binary()), pa.array([digest] * len(names))], names=["archive", "member", "content", "sha256"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if known is not None:  # archives whose hash is known are not opened again
        files = files.withColumn("sha256", F.sha2("content", 256)).join(known.select("sha256").distinct(), "sha256", "left_anti").select("path", "content")
    return files.mapInArrow(one, "archive string, member string, content binary, sha256 string")


def config(path: str) -> dict:
    """A YAML or JSON configuration."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs the yaml package; use JSON instead") from e
        return yaml.safe_load(f) or {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
