"""Where results go: Parquet tables that keep their keys, tables replaced version by version, and CSV files for people."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from xml.sax.saxutils import escape
from zipfile import ZIP_DEFLATED, ZipFile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kavosh.operators import contacts, links
from kavosh.sources.tables import read_note, write_note

#: Buckets of a table that rows are appended to; a batch looks for its keys only in the buckets they fall into.
BUCKETS = 64
_BUCKET, _CURRENT = "_bucket", "_current"


def _exists(spark: SparkSession, target: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def append_new(target: str, batch: DataFrame, keys: tuple[str, ...] = ("source_url", "phones"), order: str = "id") -> DataFrame:
    """Append the rows of a batch whose key the table at ``target`` doesn't hold; the first of a key wins.

    The table lies in buckets of the key's hash; of what is there only the keys of the batch's own buckets are read.
    """
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), F.lit(BUCKETS)).cast("int")
    fresh = batch.withColumn(_BUCKET, bucket)
    if _exists(spark, target):
        touched = [r[0] for r in fresh.select(_BUCKET).distinct().collect()]  # at most one number a bucket
        have = spark.read.parquet(target).filter(F.col(_BUCKET).isin(touched))
    else:
        have = fresh.limit(0)
    contacts.insert_ignore(have, fresh, keys, order).write.mode("append").partitionBy(_BUCKET).parquet(target)
    return spark.read.parquet(target).drop(_BUCKET)


def current(spark: SparkSession, target: str) -> DataFrame | None:
    """The valid version of a table that is replaced as a whole; None before the first."""
    version = read_note(spark, f"{target}/{_CURRENT}")
    return spark.read.parquet(f"{target}/{version}") if version else None


def replace(target: str, df: DataFrame) -> DataFrame:
    """Write a new version beside the old one and make it the valid one: readers see either, a failed job changes nothing."""
    spark, version = df.sparkSession, f"version-{uuid.uuid4().hex}"
    df.write.parquet(f"{target}/{version}")
    write_note(spark, f"{target}/{_CURRENT}", version)
    return spark.read.parquet(f"{target}/{version}")


def upsert(target: str, batch: DataFrame, first: Callable[[DataFrame], DataFrame], merged: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Fold a batch into the table at ``target``; ``first`` folds the batch of an empty table."""
    stored = current(batch.sparkSession, target)
    return replace(target, first(batch) if stored is None else merged(stored, batch))


def upsert_links(target: str, batch: DataFrame) -> DataFrame:
    """Fold edges (with first_seen and id) into a stored edge table; edges without a type are anchors."""
    typed = batch.withColumn("link_type", F.coalesce("link_type", F.lit("anchor")) if "link_type" in batch.columns else F.lit("anchor"))
    return upsert(target, typed, links.fold_links, links.merged_links)


def upsert_technologies(target: str, batch: DataFrame) -> DataFrame:
    """Fold technology evidence into a stored table."""
    return upsert(target, batch, contacts.technology_evidence, contacts.merged_technologies)


def write_csv(df: DataFrame, folder: str, one_file: bool = False) -> None:
    """CSV with a header and a byte-order mark in its first column's name, so spreadsheets read it as UTF-8.

    Written by all tasks; with ``one_file``, for exports of reading size, by one.
    """
    cells = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    cells = cells.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    (cells.coalesce(1) if one_file else cells).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(folder)


#: Rows of a sheet at most, as spreadsheets have them.
SHEET_ROWS = 1_048_576
_NAMESPACE = "http://schemas.openxmlformats.org"


def write_xlsx(df: DataFrame, path: str) -> int:
    """One spreadsheet file on the driver, every cell a text, so no leading zero is lost; how many rows it has.

    For exports of reading size: rows come partition by partition and are written as they come, so memory holds one partition;
    beyond the rows of a sheet the next begins.
    """
    rows = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]).toLocalIterator()
    bare = str.maketrans({c: None for c in map(chr, range(32)) if c not in "\t\n\r"})
    line = lambda values: "<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v.translate(bare))}</t></is></c>' for v in values) + "</row>"
    n, sheets = 0, 0
    with ZipFile(path, "w", ZIP_DEFLATED) as book:
        row = next(rows, None)
        while row is not None or not sheets:
            sheets += 1
            with book.open(f"xl/worksheets/sheet{sheets}.xml", "w", force_zip64=True) as out:
                out.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_NAMESPACE}/spreadsheetml/2006/main"><sheetData>{line(df.columns)}'.encode())
                filled = 1
                while row is not None and filled < SHEET_ROWS:
                    out.write(line(row).encode())
                    row, filled, n = next(rows, None), filled + 1, n + 1
                out.write(b"</sheetData></worksheet>")
        numbers = range(1, sheets + 1)
        relation, part = f"{_NAMESPACE}/officeDocument/2006/relationships", "application/vnd.openxmlformats-officedocument.spreadsheetml"
        book.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{_NAMESPACE}/spreadsheetml/2006/main" xmlns:r="{relation}"><sheets>' + "".join(f'<sheet name="Sheet{i}" sheetId="{i}" r:id="rId{i}"/>' for i in numbers) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{_NAMESPACE}/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{relation}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers) + "</Relationships>")
        book.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{_NAMESPACE}/package/2006/relationships"><Relationship Id="rId1" Type="{relation}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        types = f'<Override PartName="/xl/workbook.xml" ContentType="{part}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{part}.worksheet+xml"/>' for i in numbers)
        book.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{_NAMESPACE}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>')
    return n


def export_links(edges: DataFrame, urls: DataFrame, folder: str, crawlable_only: bool | None = False) -> int:
    """The external links of one crawlability (the denied ones unless told otherwise) with their states as CSV, latest first; how many there are."""
    rows = links.link_list(edges, urls, crawlable_only=crawlable_only).orderBy(F.col("first_seen").desc())
    write_csv(rows, folder)
    return rows.count()


def export_contacts(rows: DataFrame, folder: str) -> DataFrame:
    """One line a site, one value a cell, as CSV; numbers stay texts, so no leading zero is lost."""
    wide = contacts.wide(contacts.sites(rows))
    write_csv(wide, folder)
    return wide


def newest(spark: SparkSession, folder: str, ending: str = "") -> str | None:
    """The path in a folder that was changed last; None in an empty one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = [(s.getModificationTime(), s.getPath().toString()) for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    return max((f for f in found if f[1].endswith(ending)), default=(0, None))[1]
