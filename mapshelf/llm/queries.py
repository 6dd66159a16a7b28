"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapshelf.llm import chat, katz, line_crf, minhash, mixing, ordinal, packing, phrases, pivots, spelling, substring, token_store, url_model
from mapshelf.llm.common import scratch_path, stored


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents left after 20-word passages that occur earlier are removed."""
    out = substring.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2,048 tokens."""
    out = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to ORC and read back."""
    path = scratch_path(spark, "token-store")
    token_store.write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return token_store.checksums(token_store.read(spark, path))


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade of each document and the chance of the highest: toxic, poor or good."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rated = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return ordinal.grade(docs, ordinal.fit_on_ratings(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), rated, 3))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents over 4-word shingles."""
    return minhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=4).select("doc_id", "n_shingles", "component_id", "kept")


def op6_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix-target examples of all conversations and one that holds control strings, written and read back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    return chat.digests(chat.read_back(stored(chat.examples(turns.unionByName(odd)), "chat-examples")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of each document; the line labels are fitted on the labelled ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_crf.judge(docs, line_crf.fit_on_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all sources takes of each document."""
    return mixing.plan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def op8_source_mix_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix itself: the words of each slot, one row for each run."""
    out = mixing.mixed(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("shard", "slot", "source", "block", F.posexplode("runs").alias("nth", "run"))
    return out.select("shard", "slot", "source", "block", "nth", "run.doc_id", "run.start", "run.stop")


#: The rules of the URL query.
RULES = [
    url_model.Rule("allow", "com/"),
    url_model.Rule("block", "example.com/en/"),
    url_model.Rule("allow", "www.example.com/en/"),
    url_model.Rule("block", "net/es/"),
    url_model.Rule("block", "net/fr/"),
]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of each page's URL."""
    return url_model.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


def op10_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of embeddings."""
    return pivots.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents and the more frequent spelling they are a variant of."""
    return spelling.group(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those outside one fold of seven; rounded to 6 decimals, as sums of doubles depend on their order."""
    out = katz.score_held_out(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language."""
    return phrases.collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_token_store": op3_token_store,
    "op4_ordinal_quality": op4_ordinal_quality,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_chat_examples": op6_chat_examples,
    "op7_quality_rules": op7_quality_rules,
    "op8_source_mix": op8_source_mix,
    "op8_source_mix_slots": op8_source_mix_slots,
    "op9_url_filter": op9_url_filter,
    "op10_pivot_dedup": op10_pivot_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_katz_scores": op12_katz_scores,
    "op13_phrase_collocations": op13_phrase_collocations,
}

#: Words of the documents, one row each, numbered from 1 within the document.
_WORDS = r"""
words AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i
    FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)
)"""

#: Texts with A-Z in lower case.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The table of CRC-32, made from its polynomial, and the checksum of a list of bytes over it.
_CRC_TABLE = """crc_table AS (
    SELECT list(list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
    FROM (SELECT unnest(range(256))::BIGINT AS i)
)"""


def _crc(codes: str) -> str:
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _ascii(text: str) -> str:
    return f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"


def _discounts(counted: str) -> str:
    """(r, d) of Good-Turing discounts, for the largest limit up to 5 for which all are above 0 and at most 1."""
    return f"""(
    SELECT r, d FROM (
        SELECT most, r, d, bool_and(d > 0 AND d <= 1) OVER (PARTITION BY most) AS good FROM (
            SELECT most, r, ((r + 1) * q[r + 1] / (r * q[r]) - (most + 1) * q[most + 1] / q[1]) / (1 - (most + 1) * q[most + 1] / q[1]) AS d
            FROM (SELECT list(coalesce(x.c, 0)::DOUBLE ORDER BY r.r) AS q FROM (SELECT unnest(range(1, 7)) AS r) r LEFT JOIN (SELECT n, count(*) AS c FROM {counted} GROUP BY n) x ON x.n = r.r),
                 (SELECT unnest(range(1, 6)) AS most), (SELECT unnest(range(1, 6)) AS r)
            WHERE r <= most AND q[most + 1] > 0 AND (most + 1) * q[most + 1] < q[1]))
    WHERE good QUALIFY rank() OVER (ORDER BY most DESC) = 1)"""


SQL: dict[str, str] = {
    "op1_substring_dedup": rf"""
WITH {_WORDS},
windows AS (
    SELECT doc_id, i, string_agg(word, ' ') OVER w AS seq, count(*) OVER w AS n
    FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
),
repeats AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) AS nth FROM windows WHERE n = 20)
    WHERE nth > 1
),
judged AS (
    SELECT w.doc_id, w.i, w.word, max(r.i) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
    FROM words w LEFT JOIN repeats r ON r.doc_id = w.doc_id AND r.i = w.i
)
SELECT d.doc_id, count(j.i) AS n_words, count(j.i) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(j.word, ' ' ORDER BY j.i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN judged j ON j.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op5_minhash_dedup": r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
sets AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM words WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS in_both FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * in_both >= 80 * (x.n + y.n - in_both)
),
near AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, near.b FROM reach JOIN near ON near.a = reach.r)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.r) AS component_id, d.doc_id = min(r.r) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op6_chat_examples": r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
           13 + length(role) + length(regexp_replace(role, '[^\\<\[]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g')) AS chars
    FROM turns
),
grown AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS so_far FROM numbered)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (sum(so_far) FILTER (WHERE role = 'assistant' OR i = n))::BIGINT AS formatted_chars
FROM grown GROUP BY conv_id""",
    "op10_pivot_dedup": r"""
WITH RECURSIVE unit AS (
    SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings
    WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
),
good AS (SELECT * FROM unit WHERE n > 0 AND isfinite(n)),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.95),
reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(any_value(c.n), 0) AS n_links, min(r.r) AS component_id, v.vec_id = min(r.r) AS kept
FROM embeddings v JOIN reach r ON r.vec_id = v.vec_id LEFT JOIN counted c ON c.a = v.vec_id GROUP BY v.vec_id""",
    "op11_spelling_variants": rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
    SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL
),
coded AS (
    SELECT run, n, {_crc(f"list_concat({_ascii('coalesce(doc_id::VARCHAR, $$$$)')}, [58::BIGINT], flatten(list_transform(string_split(run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x) - 64] END)))")} AS h
    FROM runs, crc_table
),
words AS (
    SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM coded)
    WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
links AS (
    SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word FROM cut a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word FROM cut a JOIN words b ON a.rest = b.word
),
best AS (SELECT l.a, count(*) AS n_near, first(o.word ORDER BY o.n DESC, o.word) AS b, max(o.n) AS n FROM links l JOIN words o ON o.word = l.b GROUP BY l.a),
formed AS (SELECT w.word, CASE WHEN b.n >= 2 * w.n THEN b.b END AS form, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.n >= 2 * w.n THEN b.n END AS form_n
           FROM words w LEFT JOIN best b ON b.a = w.word),
way AS (SELECT word, word AS root, form AS next FROM formed UNION ALL SELECT way.word, f.word, f.form FROM way JOIN formed f ON f.word = way.next)
SELECT f.word, f.form, way.root, f.n, f.n_near, f.form_n FROM formed f JOIN way ON way.word = f.word AND way.next IS NULL""",
    "op12_katz_scores": rf"""
WITH {_CRC_TABLE},
docs AS (
    SELECT row_number() OVER () AS d, doc_id, {_crc(_ascii("coalesce(doc_id::VARCHAR, $$$$)"))} % 7 = 2 AS held_out,
           list_concat([' start'], regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), [' end']) AS w
    FROM documents, crc_table
),
used AS (SELECT d, held_out, b, c, count(*) AS m FROM (SELECT d, held_out, w[i] AS b, w[i + 1] AS c FROM (SELECT d, held_out, w, unnest(range(1, len(w))) AS i FROM docs)) GROUP BY ALL),
pairs AS (SELECT b, c, sum(m)::BIGINT AS n FROM used WHERE NOT held_out GROUP BY ALL),
words AS (SELECT c AS w, sum(n)::BIGINT AS n FROM pairs GROUP BY c),
total AS (SELECT sum(n)::BIGINT AS n, count(*) AS v FROM words),
d1 AS {_discounts("words")},
d2 AS {_discounts("pairs")},
p1 AS (SELECT w, n, n * coalesce(d, 1) / ((SELECT n FROM total) + (SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM d1)) AS p FROM words LEFT JOIN d1 ON r = n),
nothing AS (SELECT 1 - sum(p) AS p FROM p1),
counted AS (SELECT b, c, n, n * coalesce(d, 1) AS less FROM pairs LEFT JOIN d2 ON r = n),
uses AS (SELECT b, sum(n)::BIGINT AS h, bool_or(less < n) AS small FROM counted GROUP BY b),
p2 AS (SELECT b, c, less / (h + CASE WHEN small THEN 0 ELSE 1 END) AS p FROM counted JOIN uses USING (b)),
back AS (SELECT p2.b, (1 - sum(p2.p)) / (1 - sum(p1.p)) AS alpha FROM p2 JOIN p1 ON p1.w = p2.c GROUP BY p2.b)
SELECT d.doc_id, any_value(d.held_out) AS held_out, sum(u.m)::BIGINT AS n_tokens, coalesce(sum(u.m) FILTER (WHERE x.n > 0), 0)::BIGINT AS n_known, any_value(t.n) AS train_tokens,
       round(sum(u.m * log10((coalesce(x.n, 0) + 1) / (t.n + t.v + 1))), 6) AS base_score,
       round(sum(u.m * log10(coalesce(p2.p, coalesce(back.alpha, 1) * coalesce(x.p, nothing.p)))), 6) AS score
FROM docs d JOIN used u ON u.d = d.d LEFT JOIN p1 x ON x.w = u.c LEFT JOIN p2 ON p2.b = u.b AND p2.c = u.c LEFT JOIN back ON back.b = u.b, total t, nothing
GROUP BY d.d, d.doc_id""",
    "op13_phrase_collocations": rf"""
WITH pieces AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
),
languages AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (
    SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest(range(1, 5)) AS k)) GROUP BY ALL HAVING count(*) >= 30
),
cuts AS (
    SELECT g.lang, g.phrase, g.f AS a, cut, l.f AS l, r.f AS r, ((2000000::HUGEINT * g.f) // (l.f + r.f))::BIGINT AS score
    FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM grams) g
    JOIN grams l ON l.lang = g.lang AND l.phrase = array_to_string(g.w[1 : cut], ' ') JOIN grams r ON r.lang = g.lang AND r.phrase = array_to_string(g.w[cut + 1 : g.k], ' ')
),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
parts AS (
    SELECT g.lang, array_to_string(w[i : j], ' ') AS phrase, max(f) AS longer
    FROM (SELECT *, unnest(range(1, k + 1)) AS j FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k + 1)) AS i FROM grams)) g WHERE j - i BETWEEN 1 AND k - 2 GROUP BY ALL
),
kept AS (SELECT x.* FROM lowest x LEFT JOIN parts p ON p.lang = x.lang AND p.phrase = x.phrase WHERE p.longer IS NULL OR 100 * p.longer < 80 * x.a)
SELECT lang, row_number() OVER o AS rank, phrase, a, l, r, n, score FROM kept JOIN languages USING (lang)
WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY rank <= 2000""",
}
