import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from mapshelf.llm import pivots

SCHEMA = "vec_id long, embedding array<float>"


def brute_links(rows, threshold=0.95):
    good = {}
    for i, v in rows:
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.array(v, np.float32).astype(float)
            good[i] = x / np.sqrt(x @ x)
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold]
    roots = brute.components([i for i, _ in rows], links)
    return {i: (sum(i in p for p in links), roots[i]) for i, _ in rows}


def vectors(seed, n=500, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, dim))
    x = centres[rng.integers(0, 60, n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.15, 0.4], (n, 1))
    rows = [(int(i) * 2, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    rows += [(5000 + i, rows[3][1]) for i in range(20)] + [(6000 + i, (np.array(rows[7][1]) * (i + 2)).tolist()) for i in range(3)]
    return rows + [(7000, None), (7001, []), (7002, [0.0] * dim), (7003, [float("nan")] + [1.0] * (dim - 1)), (7004, [None] + [1.0] * (dim - 1)), (7005, [float("inf")] * dim), (7006, [1.0, 2.0]), (7007, [1.0, 2.0]), (7008, [2.0, 4.001]), (7009, [0.0, 1.0])]


@pytest.mark.parametrize("seed,block", [(1, 1500), (2, 40)])
def test_against_brute_force(spark, seed, block):
    rows = vectors(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("label", F.lit("x")).withColumn("weight", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.near_duplicates(df, pivots=64, block=block).collect()}
    assert got == brute_links(rows)


def test_recall_on_the_given_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding) if r.embedding else None) for r in df.collect()]
    x = np.array([v for _, v in rows if v and None not in v])
    x /= np.linalg.norm(x, axis=1)[:, None]
    found = sum(r.n_links for r in pivots.near_duplicates(df).collect())
    there = int((x @ x.T >= 0.95).sum()) - len(x)
    assert 0.99 * there <= found <= there


def test_edges(spark):
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in pivots.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.01]), (9, [0.0, 1.0])], SCHEMA)).collect()), key=str)
    assert got == sorted([(0, 2, None, True), (4, 2, None, False), (4, 2, None, False), (9, 0, 9, True)], key=str)
    assert pivots.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("share", [0.33, 0.6, 1.0])
def test_recall_where_one_noisy_group_is_large(spark, share):
    rng = np.random.default_rng(1)
    n, dim = 3000, 64
    group = int(n * share)
    x = np.vstack([rng.normal(size=dim) + rng.normal(size=(group, dim)) * 0.2, rng.normal(size=(n - group, dim))]).astype(np.float32)
    df = spark.createDataFrame(list(enumerate(x.tolist())), SCHEMA)
    x = x.astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    there = int((x @ x.T >= 0.95).sum()) - n
    assert there > 100_000
    found = sum(r.n_links for r in pivots.near_duplicates(df).collect())
    assert 0.99 * there <= found <= there
