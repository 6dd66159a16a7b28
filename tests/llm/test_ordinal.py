import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mapshelf.llm import ordinal

SCHEMA = "doc_id long, text string"


def test_features_are_distinct_and_whole():
    texts = ["a b a", "", None, "A, b! b!!", " ".join(f"w{i}" for i in range(50_000)), "a b a"]
    slots, first = ordinal.features(pa.array(texts))
    parts = [slots[a:z].tolist() for a, z in zip(first, first[1:])]
    assert parts[0] == parts[5] and len(parts[0]) == 3 and len(parts[1]) == len(parts[2]) == 1
    assert set(parts[0][1:]) <= set(parts[3]) and len(parts[3]) == 6 and len(parts[4]) > 40_000
    assert all(len(set(p)) == len(p) for p in parts)


def test_gradient_fits_an_order():
    rng = np.random.default_rng(1)
    grade = rng.integers(0, 3, 900)
    texts = [" ".join([["bad", "fair", "fine"][g], *(f"w{rng.integers(0, 40)}" for _ in range(20))]) for g in grade]
    slots, first = ordinal.features(pa.array(texts))
    grader = ordinal.fit(slots, first, grade, 3, telling=3.0)
    assert (np.diff(grader.thresholds) > 0).all()
    total = np.concatenate([[0], np.cumsum(grader.weights[slots])])
    above = grader.above(total[first[1:]] - total[first[:-1]])
    assert ((above > 0.5).sum(1) == grade).mean() > 0.98 and (above[:, 0] >= above[:, 1]).all()


def test_held_out_documents(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rated = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    grader = ordinal.fit_on_ratings(docs.where("doc_id % 3 > 0"), labels, rated, 3)
    out = ordinal.grade(docs.where("doc_id % 3 = 0"), grader).join(labels.withColumn("grade", rated), "doc_id")
    kept = {r.grade: (r.kept, r.expected) for r in out.groupBy("grade").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.avg("expected_grade").alias("expected")).collect()}
    assert kept[2][0] > 0.95 and kept[0][0] < 0.1 and kept[0][1] < kept[1][1] < kept[2][1]


def test_edges(spark):
    docs = spark.createDataFrame([(None, "x"), (1, None), (1, ""), (2, "y"), (2, "y")], SCHEMA).withColumn("id", F.lit(1)).withColumn("kept", F.lit(1))
    ratings = spark.createDataFrame([(1, None), (None, 1), (2, 5), (2, 0)], "doc_id long, g int")
    got = ordinal.grade(docs, ordinal.fit_on_ratings(docs, ratings, F.col("g"), 3)).collect()
    assert len(got) == 5 and len({r.expected_grade for r in got}) == 1
    assert ordinal.grade(spark.createDataFrame([], SCHEMA), ordinal.Grader(np.zeros(ordinal.SPACE), np.zeros(2))).count() == 0
