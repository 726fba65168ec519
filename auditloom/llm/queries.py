"""Queries over the text tables: each applies one operator to a whole table and returns its whole result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import chat, fingerprints, hard_negatives, langid, license_scan, mixing, near_dedup, packing, quality_model, quality_rules, sharding, spelling, toxicity
from auditloom.llm.common import read_table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), shingle_words=4, percent=80)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.train(toxicity.labelled(docs, labels), ["insult", "contempt", "toxic"]))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    learned = langid.prototypes(docs.filter(~langid.held_out()).select("text", "lang"))
    return langid.identify(docs, learned).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"]
    return quality_rules.judge(read_table(spark, sf_dir, "documents")).select(*names)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    like = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"]
    rows = fingerprints.exact_groups(read_table(spark, sf_dir, "documents"))
    return rows.select(*names, like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next"), "group_id")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality(read_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(read_table(spark, sf_dir, "documents"), shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"), damage=97)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings").withColumn("label", moved))


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select(more.columns).unionByName(more)
    return chat.read_back(chat.formatted(rows))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_toxicity,
        op3_mixing,
        op4_language_id,
        op5_quality_rules,
        op6_fingerprints,
        op7_quality_classifier,
        op8_sharding,
        op9_packing,
        op10_license_scan,
        op11_spelling_variants,
        op12_hard_negatives,
        op13_chat_formatting,
    )
}

#: Equivalent DuckDB SQL, where SQL can express the whole result.
ORACLE: dict[str, str] = {
    "op11_spelling_variants": """
WITH RECURSIVE letters AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
lowered AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM letters GROUP BY ALL),
table8 AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b)),
hashed AS (SELECT run, n, xor(list_reduce(flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, unicode(c) - 64] END)),
  lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM lowered, table8),
damaged AS (SELECT CASE WHEN h % 97 <> 0 THEN run ELSE left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3),
holes AS (SELECT word, n, length(word) AS size, k, left(word, k - 1) || substr(word, k + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS k FROM words)),
longer AS (SELECT DISTINCT w.word AS a, w.n AS an, h.word AS b, h.n AS bn FROM words w JOIN holes h ON h.rest = w.word),
near AS (SELECT a.word AS word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.rest = b.rest AND a.k = b.k AND a.size = b.size AND a.word <> b.word
  UNION ALL SELECT a, b, bn FROM longer UNION ALL SELECT b, a, an FROM longer),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS root, 0 AS k FROM formed UNION ALL SELECT s.word, f.form, k + 1 FROM steps s JOIN formed f ON f.word = s.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n FROM formed f JOIN (SELECT word, arg_max(root, k) AS root FROM steps GROUP BY word) s USING (word)""",
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS la, b.vec_id AS id, b.label AS lb, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM s WHERE la = lb) WHERE place <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.place ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.lb <> s.la AND 100 * s.score BETWEEN 80 * p.score AND 100 * p.score)
SELECT * FROM n WHERE rank <= 5""",
    "op13_chat_formatting": r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM (SELECT unnest(range(2)) AS k)),
sized AS (SELECT *, length(regexp_replace(role, '(\\|</turn>|###|: )', '\\\1', 'g')) + length(regexp_replace(text, '(\\|</turn>|###|: )', '\\\1', 'g')) + 14 AS size FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id""",
}
