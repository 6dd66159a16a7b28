"""Cleaning of submitted download links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Link patterns, result formats and the characters a file name may hold.
DRIVE_ID_PATTERNS = [r"^.*id=([^/&]+).*$", r"^.*file/d/([^/&]+).*$"]
DRIVE_RESULT = "https://docs.google.com/uc?export=download&id=%s"
ONEDRIVE_RESULT = "https://onedrive.live.com/download?cid=%s"
DROPBOX_PATTERN = r"^.*dropbox.com/([^&?]+).*$"
DROPBOX_RESULT = "https://www.dropbox.com/%s?dl=1"
NAME_CHARS = r"[^\"'?*/\\]+"
HEADER_NAME_PATTERN = rf"^.*filename=[\"']?({NAME_CHARS})[\"']?.*$"


def _hit(url: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))


def direct_download_url(url: Column) -> Column:
    """``struct<url, error>``: the address that serves the file itself.

    Drive and Dropbox links without a file id, and OneDrive links without ``file/d/``, give a
    NULL url and an error text. Other links come back unchanged.
    """
    drive_id = F.coalesce(*[_hit(url, p) for p in DRIVE_ID_PATTERNS])
    marker = F.locate("file/d/", url)
    one_id = F.when(marker > 0, F.trim(F.substr(url, marker + 7)))
    box_path = _hit(url, DROPBOX_PATTERN)
    target = (
        F.when(F.contains(url, F.lit("drive.google.com")), F.format_string(DRIVE_RESULT, drive_id))
        .when(F.contains(url, F.lit("onedrive.live.com")), F.format_string(ONEDRIVE_RESULT, one_id))
        .when(F.contains(url, F.lit("dropbox.com")), F.format_string(DROPBOX_RESULT, box_path))
        .otherwise(url))
    found = (
        F.when(F.contains(url, F.lit("drive.google.com")), drive_id.isNotNull())
        .when(F.contains(url, F.lit("onedrive.live.com")), one_id.isNotNull())
        .when(F.contains(url, F.lit("dropbox.com")), box_path.isNotNull())
        .otherwise(url.isNotNull()))
    return F.struct(
        F.when(found, target).alias("url"),
        F.when(~found, F.concat(F.lit("Cannot parse link: "), url)).alias("error"))


def filename_of(url: Column, content_disposition: Column | None = None) -> Column:
    """``struct<filename, error>``: name from the header, else the last path segment, else
    ``part-NNNNN`` from a hash of the link, so that a rerun gives the same name."""
    header = _hit(content_disposition, HEADER_NAME_PATTERN) if content_disposition is not None \
        else F.lit(None).cast("string")
    last = F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)
    from_url = F.when(F.regexp_like(last, F.lit(rf"^{NAME_CHARS}$")), last)
    made = F.format_string("part-%05d", F.pmod(F.crc32(url), F.lit(100000)))
    known = F.startswith(url, F.lit("http")) | F.startswith(url, F.lit("ftp"))
    return F.struct(
        F.when(known, F.coalesce(header, from_url, made)).alias("filename"),
        F.when(~known, F.concat(F.lit("Unsupported protocol for URL: "), url)).alias("error"))


def unique_filenames(df: DataFrame, by: str, url: str = "url", header: str | None = None) -> DataFrame:
    """Adds ``filename`` and ``error``; no two links of a dataset (``by``) have one name.

    Where a name repeats, the first link in the order of links keeps it; the others get a number and a part of their link's hash before the
    extension. Rows that repeat a link share its name.
    """
    named = df.withColumn("_name", filename_of(F.col(url), F.col(header) if header else None))
    links = named.where(F.col("_name.filename").isNotNull()).select(by, url, F.col("_name.filename").alias("_plain")).distinct()
    same = Window.partitionBy(by, "_plain").orderBy(url)
    tried = links.withColumn("_nth", F.row_number().over(same) - 1)
    stem, dot = F.regexp_extract("_plain", r"^(.+?)((?:\.[^.]*)?)$", 1), F.regexp_extract("_plain", r"^(.+?)((?:\.[^.]*)?)$", 2)
    numbered = F.concat(stem, F.lit("-"), F.col("_nth").cast("string"), F.lit("-"), F.substring(F.md5(F.col(url)), 1, 12), dot)
    made = tried.select(by, url, "_plain", F.when(F.col("_nth") > 0, numbered).otherwise(F.col("_plain")).alias("filename"))
    out = named.withColumn("_plain", F.col("_name.filename")).join(made, [by, url, "_plain"], "left")
    return out.select(*df.columns, "filename", F.col("_name.error").alias("error"))
