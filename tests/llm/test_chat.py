import hashlib
import random

from pyspark.sql import functions as F

from mapshelf.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for i, t, r, x in rows if i == c))
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        out[c] = len(turns), sha("".join(f"{r}\n{x}\n" for *_, r, x in turns)), len(loss), sha(loss)
    return out


def digest(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chat.read_back(chat.examples(df))).collect()}


def test_round_trip(spark):
    r = random.Random(3)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "\\l", "\\e", "\\b", "<", "[", "a", " ", "\n", "é", "日", "😀", "$1", "\\\\"]
    rows = [(c, t, r.choice(["user", "assistant", "system", "[INST]", None, ""]), r.choice([None, ""]) if r.random() < 0.1 else "".join(r.choice(bits) for _ in range(r.randrange(30))))
            for c in range(60) for t in range(r.randrange(1, 12))]
    rows += [(None, 0, "assistant", "no id"), (99, None, "user", "x"), (99, 0, "assistant", "y"), (99, 0, "assistant", "y"), (98, 0, "user", None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumn("pieces", F.lit(1)).withColumn("context", F.lit("z"))
    assert digest(df) == plain(rows)


def test_examples(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a<"), (1, 3, "user", "v"), (1, 4, "assistant", "b"), (1, 5, "user", "w")]
    got = chat.examples(spark.createDataFrame(rows, SCHEMA)).orderBy("position").collect()
    assert [r.position for r in got] == [3, 5, 6]
    assert [r.formatted[r.loss_start - 1 : r.loss_start - 1 + r.loss_length] for r in got] == ["a\\l", "b", ""]
    assert got[1].formatted == got[0].formatted + "<s>user[INST]v</s><s>assistant[INST]b</s>"


def test_long_and_empty(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], f"turn {t} " * 3) for t in range(400)] + [(2, 0, "assistant", "x" * 2_000_000)]
    assert digest(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    assert digest(spark.createDataFrame([], SCHEMA)) == {}


def test_no_python_in_the_plan(spark):
    df = chat.digests(chat.read_back(chat.examples(spark.sql("SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, 'x' AS text"))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
