import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mapshelf.llm import url_model
from mapshelf.llm.queries import RULES

SCHEMA = "page_id long, url string"


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:end], rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def ruled(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


URLS = ["http://a.com/x", "http://com/", "http://COM/é", "https://example.com/en/1", "https://example.com/en", "http://www.example.com/en/2?q#f", "http://m.www.example.com/en/", "http://notexample.com/en/",
        "http://x.net/es/1", "http://x.net/fr/", "http://x.net/de/", "ftp://x.net?/es/", "x.com/en/", "", None, "://", "http://a.b.org:80/p?x=http://b.com/", "http://com", "http://é.com/ü", "http://x.com\n/y", "http://.com/", "a://b://c/d"]


def test_parts_and_rules(spark):
    rows = list(enumerate(URLS)) + [(None, "http://a.com/"), (1, URLS[1])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("host", F.lit(1)).withColumn("best", F.lit(2))
    got = url_model.filter_urls(df, RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is None:
            continue
        host, path = parts(URLS[r.page_id])
        rule = ruled(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.text)
        assert r.verdict == rule.verdict if rule else r.verdict in ("allow", "block")


def test_scores_against_plain_counts(spark):
    """Where no two contexts share a slot, the tables give the scores of plain counts."""
    r = random.Random(2)
    urls = ["http://" + "".join(r.choice("abcé/.") for _ in range(r.randrange(1, 12))) for _ in range(60)]
    data = [(i, u) for i, u in enumerate(urls)]
    rules = [url_model.Rule("allow", "a"), url_model.Rule("block", "b")]
    df = url_model.split(spark.createDataFrame(data, SCHEMA), rules)
    df = df.withColumn("best", F.struct(F.lit(1).alias("length"), F.lit("x").alias("text"), F.when(F.col("page_id") % 2 == 0, "allow").otherwise("block").alias("verdict")))
    model = url_model.fit(df)
    counts = [[Counter(), Counter()] for _ in range(2)]
    for i, u in data:
        u = u.encode()
        for at in range(len(u)):
            for order in range(url_model.ORDER + 1):
                context = (order, tuple(u[at - j] if at >= j else -1 for j in range(1, order + 1)))
                counts[i % 2][0][context] += 1
                counts[i % 2][1][context, u[at]] += 1

    def plain(u):
        total = 0.0
        for at in range(len(u)):
            chance = [1 / 256, 1 / 256]
            for order in range(url_model.ORDER + 1):
                context = (order, tuple(u[at - j] if at >= j else -1 for j in range(1, order + 1)))
                chance = [(counts[c][1][context, u[at]] + url_model.STRENGTH * chance[c]) / (counts[c][0][context] + url_model.STRENGTH) for c in (0, 1)]
            total += math.log(chance[0]) - math.log(chance[1])
        return total / max(len(u), 1)

    got = url_model.score(model.counts, url_model.Contexts(pa.array([*urls, "", None, "http://zz"])))
    wanted = [plain(u.encode()) for u in [*urls, "", "", "http://zz"]]
    close = [abs(a - b) < 1e-4 for a, b in zip(got, wanted)]
    assert sum(close) >= 0.7 * len(close) and max(abs(a - b) for a, b in zip(got, wanted)) < 0.5


def test_held_out_urls(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice(["tion", "er", "in", "th", "re", "on"]) for _ in range(3))
    rows = [(i, f"http://{word()}.com/{word()}/article-{r.randrange(99)}" if i % 2 else f"http://{word()}.net/es/buy-{r.randrange(9)}/cheap?{word()}") for i in range(3000)]
    rows += [(10_000 + i, f"http://{word()}.org/{word()}/article-{r.randrange(99)}" if i % 2 else f"http://{word()}.org/shop/buy-{r.randrange(9)}/cheap?{word()}") for i in range(400)]
    got = {x.page_id: x.verdict for x in url_model.filter_urls(spark.createDataFrame(rows, SCHEMA), RULES).collect()}
    right = sum(got[10_000 + i] == ("allow" if i % 2 else "block") for i in range(400))
    assert right >= 380


@pytest.mark.parametrize("rows", [[], [(1, "http://a.org/")], [(1, "http://a.com/"), (2, "http://a.org/")]])
def test_without_examples(spark, rows):
    got = url_model.filter_urls(spark.createDataFrame(rows, SCHEMA), RULES).collect()
    assert len(got) == len(rows) and all(r.verdict in ("allow", "block") for r in got)
    assert url_model.filter_urls(spark.createDataFrame(rows, SCHEMA), []).count() == len(rows)


def test_counts_stay_exact_as_the_table_grows(spark):
    """With far more than 65,536 distinct contexts, no two of them share a count."""
    r = random.Random(4)
    urls = ["http://" + "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789-/.") for _ in range(70)) for _ in range(3000)]
    df = spark.createDataFrame([(i, u, {"verdict": "block" if i % 2 else "allow"}) for i, u in enumerate(urls)], "page_id long, url string, best struct<verdict:string>")
    model = url_model.fit(df)
    counts = [Counter(), Counter()]
    for i, u in enumerate(urls):
        u = (-1,) * url_model.ORDER + tuple(u.encode())
        for at in range(url_model.ORDER, len(u)):
            for order in range(url_model.ORDER + 1):
                counts[i % 2][u[at - order : at]] += 1
                counts[i % 2][u[at - order : at], u[at]] += 1
    assert len(counts[0]) > 200_000

    def plain(u):
        total = 0.0
        u = (-1,) * url_model.ORDER + tuple(u.encode())
        for at in range(url_model.ORDER, len(u)):
            chance = [1 / 256, 1 / 256]
            for order in range(url_model.ORDER + 1):
                context = u[at - order : at]
                chance = [(counts[c][context, u[at]] + url_model.STRENGTH * chance[c]) / (counts[c][context] + url_model.STRENGTH) for c in (0, 1)]
            total += math.log(chance[0]) - math.log(chance[1])
        return total / (len(u) - url_model.ORDER)

    some = [*urls[:20], "http://abc.def/none"]
    assert list(url_model.score(model.counts, url_model.Contexts(pa.array(some)))) == pytest.approx([plain(u) for u in some], abs=1e-9)
    unruled = spark.createDataFrame([(i, u, None) for i, u in enumerate(some)], "page_id long, url string, best struct<text:string,verdict:string>").withColumn("host", F.lit("")).withColumn("path", F.lit(""))
    got = {x.page_id: x.score for x in url_model.judge(unruled, model).collect()}
    assert [got[i] for i in range(len(some))] == pytest.approx([model.slope * plain(u) + model.offset for u in some], abs=1e-6)


def test_cells_are_not_broadcast(spark):
    """The cells of URLs come out of a small file, and are many times as many bytes."""
    pages = spark.createDataFrame([(i, f"http://a{i}.com/{i}") for i in range(20)] + [(i, f"http://b{i}.net/es/{i}") for i in range(20)], SCHEMA)
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 1 << 20
    plan = url_model.filter_urls(pages, RULES)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
