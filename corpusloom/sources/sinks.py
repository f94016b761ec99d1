"""Sinks: tables for data, small documents for reports."""

from __future__ import annotations

import csv
import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Reports are small; a larger table is refused instead of collected.
REPORT_ROWS = 100_000


def table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet, a new folder for each stage: a stage never overwrites its own input."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def predictions(df: DataFrame, path: str) -> None:
    """Replace the partitions (model_id, split) that df holds and keep the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_id", "split").parquet(path)


def report_rows(df: DataFrame) -> list[dict]:
    rows = [r.asDict(recursive=True) for r in df.limit(REPORT_ROWS + 1).collect()]
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report of more than {REPORT_ROWS} rows; write it as a table")
    return rows


def json_report(df: DataFrame, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report_rows(df), f, ensure_ascii=False, indent=2, default=str)


def csv_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame) -> str:
    rows, cols = report_rows(df), df.columns
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols)]
    return "\n".join(lines + ["| " + " | ".join(show(r[c]) for c in cols) + " |" for r in rows]) + "\n"


def registry_upsert(old: DataFrame, new: DataFrame, key: str = "model_id", family: str | None = None) -> DataFrame:
    """Rows of both; where a key is in both, the new row.  With family, old rows of that column's values in new are replaced as a whole, all other families stay."""
    if family:
        old = old.join(new.select(family).distinct(), family, "left_anti").select(*old.columns)
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def example_sheet(df: DataFrame, path: str, title: str = "Examples") -> None:
    """A Markdown sheet of a small table, such as error_examples."""
    _write(path, f"# {title}\n\n{markdown(df)}")


def multi_table_csv(tables: Sequence[DataFrame], path: str) -> None:
    """Several small tables in one CSV file, a blank line between them."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        w = csv.writer(f)
        for k, t in enumerate(tables):
            if k:
                w.writerow([])
            w.writerow(t.columns)
            w.writerows(list(r.values()) for r in report_rows(t))


def provenance(path: str, source: str, files: DataFrame, when: str) -> dict:
    """Add the hashes of a source's files (member, sha256) to a provenance document and give it back."""
    doc = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            doc = json.load(f)
    doc[source] = {"at": when, "files": {r["member"]: r["sha256"] for r in report_rows(files.select("member", "sha256").distinct())}}
    _write(path, json.dumps(doc, ensure_ascii=False, indent=2, sort_keys=True))
    return doc


def tracker_log(path: str, run: str, params: dict, metrics: dict) -> bool:
    """Append a run to a log of JSON lines; a log that can't be written is no error."""
    try:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "a", encoding="utf-8") as f:
            f.write(json.dumps({"run": run, "params": params, "metrics": metrics}, ensure_ascii=False, sort_keys=True, default=str) + "\n")
        return True
    except OSError:
        return False


def model_card(path: str, model_id: str, config: dict, metrics: DataFrame, notes: str = "") -> None:
    """What a model is, how it was made and how well it does, as a Markdown page."""
    lines = [f"# {model_id}", "", "## Configuration", "", *[f"- {k}: {v}" for k, v in sorted(config.items())], "", "## Metrics", "", markdown(metrics)]
    _write(path, "\n".join(lines + (["## Notes", "", notes, ""] if notes else [])))


def export_linear(document: dict, path: str) -> None:
    """A linear model (models.linear_document) as a JSON file.  Vocabularies are bounded by their size limit."""
    _write(path, json.dumps(document, ensure_ascii=False))


def _write(path: str, text: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def manifest(df: DataFrame, id_col: str = "id", split: str = "split", buckets: int = 256) -> DataFrame:
    """(bucket, n, digest): a content hash of the assignment of ids to splits.

    Lines `id:split` are hashed in buckets by the first byte of the id's md5, each in order of id; the table of
    buckets is the frozen signature and is compared row by row.
    """
    line = F.concat_ws(":", F.col(id_col), F.coalesce(F.col(split), F.lit("")))
    rows = df.select(F.substring(F.md5(id_col), 1, 2).alias("bucket"), F.md5(line).alias("h"))
    # Sum of hash halves: order-free and combined on the map side, so no bucket is collected.
    part = lambda i: F.conv(F.substring("h", i, 8), 16, 10).cast("decimal(38,0)")
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(part(1)).cast("string").alias("digest_a"), F.sum(part(9)).cast("string").alias("digest_b"))
