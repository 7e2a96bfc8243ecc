"""File listings: dataset discovery (SRC-7), thumbnails (SRC-8), image
archives (SRC-9).

Listings use the ``binaryFile`` source selecting only ``path`` (the file
contents are not read), so discovery is a distributed metadata scan.
"""

from __future__ import annotations

import io
import os
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurescape.functions.view import mime_type
from featurescape.sources.interchange import FILE_PATTERN

# File names accepted as thumbnails (case-insensitive).
IMAGE_PATTERN = r"(?i)\.(png|jpe?g|webp)$"


def discover(spark: SparkSession, folder: str, source: str = "local") -> DataFrame:
    """SRC-7: parse ``<base>.<ddMMyyyy>.<type>[.<subtype>].json`` names into
    catalogue rows ``(dataset, source, time, kind, subtype, path)``; other
    names are ignored.  Times sort as text within a dataset (Q16)."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.json")
                  .load(folder).select("path"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    pat = "(?U)" + FILE_PATTERN
    rows = files.select(
        F.regexp_extract(name, pat, 1).alias("dataset"), F.lit(source).alias("source"),
        F.regexp_extract(name, pat, 2).alias("time"), F.regexp_extract(name, pat, 3).alias("kind"),
        F.regexp_extract(name, pat, 4).alias("subtype"), name.alias("path"))
    rows = rows.where(name.rlike(pat))
    return rows.withColumn("subtype", F.when(F.col("subtype") != "", F.col("subtype")))


def read_thumbnails(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-8: images of a dataset keyed by item id (file name without the
    extension): ``(id, path, mime, content)``."""
    df = spark.read.format("binaryFile").load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    df = df.where(name.rlike(IMAGE_PATTERN))
    return df.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("id"), "path",
                     mime_type(name).alias("mime"), "content")


_ARCHIVE_SCHEMA = "archive string, name string, content binary"


def _unpack(batches):
    """Per archive: flatten members to base names, later member wins; the
    zip central directory decides the winners before any member is read."""
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            archive = os.path.splitext(os.path.basename(path))[0]
            with zipfile.ZipFile(io.BytesIO(content)) as zf:
                members = [m for m in zf.namelist() if not m.endswith("/")]
                last = {}
                for i, m in enumerate(members):
                    last[os.path.basename(m)] = i
                out_names, out_bytes = [], []
                for i, m in enumerate(members):
                    base = os.path.basename(m)
                    if last[base] != i:
                        continue
                    out_names.append(base)
                    out_bytes.append(zf.read(m))
                    if len(out_names) >= 256:
                        yield pd.DataFrame({"archive": archive, "name": out_names, "content": out_bytes})
                        out_names, out_bytes = [], []
                if out_names:
                    yield pd.DataFrame({"archive": archive, "name": out_names, "content": out_bytes})


def unpack_archives(spark: SparkSession, folder: str, images_only: bool = False) -> DataFrame:
    """SRC-9: members of every ``*.zip`` in ``folder`` as ``(archive, name,
    content)`` rows (one archive per task, members streamed in batches)."""
    zips = (spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder)
                 .select("path", "content"))
    out = zips.mapInPandas(_unpack, _ARCHIVE_SCHEMA)
    if images_only:
        out = out.where(F.col("name").rlike(IMAGE_PATTERN))
    return out
