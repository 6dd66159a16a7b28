"""Documents whose text is spread over many rows.

A document is a DataFrame of ``part``, ``sort_key`` and ``line``: part 0 opens it, part 1 is the first
record, part 2 the others and part 3 closes it. No row holds more than one record, so a
document of any size is written by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def framed(body: DataFrame, head: str, tail: str) -> DataFrame:
    """Body rows (part, sort_key, line) between an opening and a closing line."""
    key = body.schema["sort_key"].dataType.simpleString()
    frame = body.sparkSession.createDataFrame([(0, head), (3, tail)], "part int, line string")
    return body.unionByName(frame.selectExpr("part", f"cast(null as {key}) AS sort_key", "line"))


def json_document(body: DataFrame, head: str, tail: str) -> DataFrame:
    """JSON records between an opening and a closing line, with a comma before all but the first.

    The first record is the one with the smallest ``sort_key``, missing ones before all others, and the smallest text
    among equal keys.
    """
    record = F.struct("sort_key", "line")
    first = record.eqNullSafe(body.agg(F.min(record)).scalar())
    lines = body.select(
        F.when(first, F.lit(1)).otherwise(F.lit(2)).alias("part"), "sort_key",
        F.when(first, F.col("line")).otherwise(F.concat(F.lit(","), F.col("line"))).alias("line"))
    return framed(lines, head, tail)


def write_document(document: DataFrame, path: str, compression: str = "none", ordered: bool = False,
                   max_records: int = 0) -> None:
    """Text files below ``path`` that give the document when read one after the other by path.

    The parts go to folders of their own, so records need no sorting unless their order counts. A file holds at most
    ``max_records`` records, if that is given.
    """
    rows = document.orderBy("part", "sort_key") if ordered else document
    writer = rows.select("part", "line").write.mode("errorifexists").option("maxRecordsPerFile", max_records)
    writer.partitionBy("part").text(path, compression=compression)
