"""URL filters: allow and block rules, and a character language model for the URLs that no rule fits.

URLs with a rule are the accepted and rejected examples. Two variable-order Markov models over the bytes of a URL are counted from all of them: the
chance of a byte after the longest context mixes its count there with the chance after the next shorter one. The difference of a URL's two
log-likelihoods per byte, calibrated by a logistic curve, gives the verdict. Curve and models do not see the same URL: the models are counted in two
halves, and each half is scored by the other.

The counts are a Spark table with one row for each context, and for each context with a byte, that occurs; it grows with the corpus. To be scored,
URLs are dealt to groups of bounded size; a group's distinct cells are joined to the table, and the counts found go to the group's URLs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapshelf.llm.common import batch, byte_lengths, numbers, pieces, raw_bytes, stored

ORDER, STRENGTH = 5, 4.0  # a cell of more than 5 bytes and a byte does not fit 64 bits
BINS, WIDTH = 400, 0.05
GROUP = 1 << 19  # bytes of URLs


@dataclass(frozen=True)
class Rule:
    """A host and the beginning of a path, as in ``example.com/en/``."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without one."""
    found = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def best_rule(rules: Sequence[Rule]) -> Column:
    """The longest rule that fits the columns ``host`` and ``path``, as (length, text, verdict); null if none does. Of a rule given twice, block holds."""
    if not rules:
        return F.lit(None).cast("struct<length:int,text:string,verdict:string>")
    by_host: dict[str, list[Rule]] = {}
    for rule in rules:
        by_host.setdefault(rule.host, []).append(rule)
    entry = lambda r: F.struct(F.lit(len(r.text)).alias("length"), F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"), F.lit(r.path).alias("path"))
    table = F.create_map(*[x for h, some in by_host.items() for x in (F.lit(h), F.array(*map(entry, some)))])
    labels = F.size(F.split("host", r"\."))
    hosts = F.transform(F.sequence(F.lit(1), labels), lambda i: F.array_join(F.slice(F.split("host", r"\."), -i, i), "."))
    found = F.flatten(F.filter(F.transform(hosts, lambda h: F.try_element_at(table, h)), lambda x: x.isNotNull()))
    fits = F.transform(F.filter(found, lambda r: F.startswith(F.col("path"), r["path"])), lambda r: F.struct(r["length"].alias("length"), r["text"].alias("text"), r["verdict"].alias("verdict")))
    return F.array_max(fits)


class Contexts:
    """Cells of the bytes of many URLs: for each order, of the context and of the context with the byte. Different ones have different numbers."""

    def __init__(self, urls: pa.Array):
        data, offsets = raw_bytes(urls)
        self.offsets = offsets
        place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
        self.context, self.byte = [], []
        key = np.zeros(len(data), np.int64)
        for order in range(ORDER + 1):
            if order:  # a place before the URL's first byte counts as a byte of its own
                key = key | np.where(place >= order, np.roll(data, order), 256).astype(np.int64) << 9 * order
            self.context.append(key << 4 | order << 1)
            self.byte.append((key | data) << 4 | order << 1 | 1)

    def cells(self) -> np.ndarray:
        return np.unique(np.concatenate([np.unique(x) for x in (*self.context, *self.byte)]))


class Counts:
    """The counts of some cells; those of all others are 0."""

    def __init__(self, cell: np.ndarray, accepted: np.ndarray, rejected: np.ndarray):
        self.cell, first = np.unique(np.append(cell, np.iinfo(np.int64).max), return_index=True)
        self.classes = [np.append(x, 0).astype(np.float64)[first] for x in (accepted, rejected)]

    def at(self, cell: np.ndarray) -> list[np.ndarray]:
        """Of the accepted and of the rejected."""
        row = np.searchsorted(self.cell, cell)
        return [np.where(self.cell[row] == cell, x[row], 0) for x in self.classes]


def score(counts: Counts | DataFrame, found: Contexts) -> np.ndarray:
    """Log-likelihood per byte of the accepted less that of the rejected; 0 for an empty URL. Of a table of counts, the cells of these URLs are fetched."""
    if isinstance(counts, DataFrame):
        cells = counts.sparkSession.createDataFrame([(x,) for x in found.cells().tolist()], "cell long")
        rows = counts.join(cells, "cell").select("cell", "accepted", "rejected").collect()
        counts = Counts(*np.array(rows, np.int64).reshape(-1, 3).T)
    chances = [np.full(int(found.offsets[-1]), 1 / 256)] * 2
    for order in range(ORDER + 1):
        both = zip(chances, counts.at(found.byte[order]), counts.at(found.context[order]))
        chances = [(whole + STRENGTH * chance) / (context + STRENGTH) for chance, whole, context in both]
    total = np.concatenate([[0], np.cumsum(np.log(chances[0]) - np.log(chances[1]))])
    return np.diff(total[found.offsets]) / np.maximum(np.diff(found.offsets), 1)


@dataclass(frozen=True)
class UrlModel:
    """counts: (cell, accepted, rejected); a score s is accepted if slope * s + offset is 0 or more."""

    counts: DataFrame
    slope: float
    offset: float


def _count(known: DataFrame) -> DataFrame:
    """(cell, accepted0, rejected0, accepted1, rejected1): the counts of both halves over all URLs with a rule."""
    schema = pa.schema([("cell", pa.int64()), ("which", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in pieces(b, "url", GROUP)):
            group = numbers(part.column("half")) * 2 + numbers(part.column("rejected"))
            for which in np.unique(group).tolist():
                found = Contexts(part.filter(pa.array(group == which)).column("url"))
                for cells in (*found.context, *found.byte):
                    cell, n = np.unique(cells, return_counts=True)
                    yield batch(schema, cell, np.full(len(cell), which), n)

    names = ("accepted0", "rejected0", "accepted1", "rejected1")
    sums = [F.sum(F.when(F.col("which") == i, F.col("n")).otherwise(0)).alias(name) for i, name in enumerate(names)]
    return stored(known.mapInArrow(count, "cell long, which int, n long").groupBy("cell").agg(*sums), "url-counts")


def _with_counts(rows: DataFrame, counts: DataFrame, apply: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``apply`` makes of each group of the rows and of the counts of its cells."""
    names = rows.columns

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = TaskContext.get().partitionId() << 32, 0
        for part in (p for b in batches for p in pieces(b, "url", GROUP // 4)):
            size = int(byte_lengths(part.column("url")).sum()) + part.num_rows
            if held and held + size > GROUP:
                group, held = group + 1, 0
            held += size
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, group))], names=[*names, "group"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = pa.schema([("group", pa.int64()), ("cell", pa.int64())])
        for part in batches:
            group = numbers(part.column("group"))
            for one in np.unique(group).tolist():
                cell = Contexts(part.filter(pa.array(group == one)).column("url")).cells()
                yield batch(named, np.full(len(cell), one), cell)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    dealt = stored(rows.mapInArrow(deal, f"{kinds}, group long"), "urls-dealt")
    # Sorted and merged: the planner takes the cells for as small as the written URLs that they come from, hundreds of times too small to broadcast.
    needed = dealt.select("group", "url").mapInArrow(cells, "group long, cell long").join(counts.hint("merge"), "cell")
    return dealt.groupBy("group").cogroup(needed.groupBy("group")).applyInArrow(apply, schema)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    """A column in one piece."""
    whole = column.combine_chunks()
    return pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) and whole.num_chunks else whole


def _calibrate(known: DataFrame, counts: DataFrame) -> tuple[float, float]:
    """Slope and offset of a logistic curve over the scores that each half gets from the other, both classes weighing the same."""
    schema = pa.schema([("rejected", pa.int32()), ("bin", pa.int32())])

    def bins(urls: pa.Table, needed: pa.Table) -> pa.Table:
        urls, half = urls.combine_chunks(), numbers(urls["half"])
        s = np.zeros(len(half))
        for one in (0, 1):
            some = Contexts(_whole(urls.filter(pa.array(half == one))["url"]))
            s[half == one] = score(Counts(needed["cell"], needed[f"accepted{1 - one}"], needed[f"rejected{1 - one}"]), some)
        return pa.Table.from_batches([batch(schema, numbers(urls["rejected"]), np.clip(np.floor(s / WIDTH), -BINS, BINS - 1).astype(np.int32))])

    rows = _with_counts(known, counts, bins, "rejected int, bin int").groupBy("rejected", "bin").count().collect()  # 4 x BINS at most
    x = np.array([(r["bin"] + 0.5) * WIDTH for r in rows])
    y = np.array([1.0 - r["rejected"] for r in rows])
    n = np.array([float(r["count"]) for r in rows])
    if not (y == 1).any() or not (y == 0).any():
        return 1.0, 0.0
    n /= np.where(y == 1, n[y == 1].sum(), n[y == 0].sum())
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = n * p * (1 - p)
        g = np.array([(n * (y - p) * x).sum() - 1e-3 * a, (n * (y - p)).sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -5, 5)), b + float(np.clip(step[1], -5, 5))
        if abs(step).max() < 1e-9:
            break
    return max(a, 1e-6), b


def split(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, url, host, path, best): the parts of each URL and its longest rule."""
    url = F.col(url_col).cast("string")
    return pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host(url).alias("host"), path(url).alias("path")).withColumn("best", best_rule(rules))


def fit(parts: DataFrame) -> UrlModel:
    """Count and calibrate on all URLs with a rule."""
    known = parts.where("best IS NOT NULL").select("url", F.pmod(F.xxhash64("url"), F.lit(2)).cast("int").alias("half"), (F.col("best.verdict") == "block").cast("int").alias("rejected"))
    counts = _count(known)
    slope, offset = _calibrate(known, counts)
    both = (F.col("cell"), *((F.col(f"{x}0") + F.col(f"{x}1")).alias(x) for x in ("accepted", "rejected")))
    return UrlModel(counts.select(*both), slope, offset)


def judge(parts: DataFrame, model: UrlModel) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): the verdict is the rule's, or else the model's; ``score`` is the calibrated one.

    A null or empty URL has an empty host and path, fits no rule and scores the curve's offset. One row per row of the pages; rows do not touch one
    another, so ties and repeats get equal verdicts. Without URLs of both verdicts the curve is the plain difference, 0 and more being allowed. URLs are read
    whole; an empty table gives no rows.
    """
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("ruled", pa.string()), ("score", pa.float64())])

    slope, offset = model.slope, model.offset

    def apply(urls: pa.Table, needed: pa.Table) -> pa.Table:
        s = slope * score(Counts(needed["cell"], needed["accepted"], needed["rejected"]), Contexts(_whole(urls["url"]))) + offset
        return pa.Table.from_batches([batch(schema, *(_whole(urls[name]) for name in ("page_id", "host", "path", "rule", "ruled")), s)])

    rows = parts.select(F.col("page_id").cast("long").alias("page_id"), "url", "host", "path", F.col("best.text").alias("rule"), F.col("best.verdict").alias("ruled"))
    out = _with_counts(rows, model.counts, apply, "page_id long, host string, path string, rule string, ruled string, score double")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0, "allow").otherwise("block")).alias("verdict"), "score")


def filter_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Fit on the pages' own ruled URLs and judge all of them; other columns are left out."""
    parts = split(pages, rules, id_col, url_col)
    return judge(parts, fit(parts)).withColumnRenamed("page_id", id_col)
