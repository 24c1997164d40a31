"""The registered queries of this subpackage: each applies one operator, as it is meant for production, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwise.llm import collocations, lexicon, ngram_trie, order_minhash, packing, quality, repeats, sharding, shingle_join, token_counts, toxicity, whitening
from gridwise.shared import stored


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = order_minhash.fingerprints(_documents(spark, sf_dir)).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("edited")
    out = order_minhash.with_next(stored(prints, "fingerprints"))
    as_text = order_minhash.as_text
    return out.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("signature")).alias("fingerprint"), as_text(F.col("edited_signature")).alias("edited_fingerprint"), "near_edited", "near_next")


def op2_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.attribute_lines(_documents(spark, sf_dir))


def op3_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    out = lexicon.encode_decode(docs, lexicon.build_lexicon(docs))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_best_fit(_documents(spark, sf_dir), matrix=True)


def op5_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"]
    return quality.quality(_documents(spark, sf_dir)).select(*base)


def op6_toxic_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.ToxicityModel.fit(toxicity.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_along_curve(_documents(spark, sf_dir))


def op8_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    training = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 != 0
    return ngram_trie.score(_documents(spark, sf_dir), training)


def op9_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.feistel_shards(_documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row")


def op10_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.near_duplicates(_documents(spark, sf_dir), words=4, percent=85)


def op11_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_seed_extend_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


#: Words are cut at space and \x09 to \x0D and hold no space, so joined shingles stay apart.
OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+') IF x <> ''] AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] END) AS shingle
  FROM words
), sizes AS (
  SELECT words.doc_id, count(shingle) AS n FROM words LEFT JOIN shingles ON shingles.doc_id = words.doc_id GROUP BY words.doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reached AS (
  SELECT a, b FROM links UNION SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b
)
SELECT sizes.doc_id, sizes.n AS n_shingles, least(sizes.doc_id, coalesce(min(reached.b), sizes.doc_id)) AS component_id
FROM sizes LEFT JOIN reached ON reached.a = sizes.doc_id GROUP BY sizes.doc_id, sizes.n
"""


OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[ \x09-\x0D]+') IF x <> ''] AS w FROM documents
), windows AS (
  SELECT doc_id, i AS start, array_to_string(w[i:i + 19], ' ') AS run FROM words, unnest(range(1, len(w) - 18)) AS t(i)
), later AS (
  SELECT doc_id, start FROM windows QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, start) > 1
), removed AS (
  SELECT doc_id, list(DISTINCT start + k) AS gone FROM later, unnest(range(0, 20)) AS t(k) GROUP BY doc_id
), left_words AS (
  SELECT doc_id, i, w[i] AS word FROM words, unnest(range(1, len(w) + 1)) AS t(i)
), kept AS (
  SELECT l.doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM left_words l
  LEFT JOIN (SELECT doc_id, unnest(gone) AS i, true AS hit FROM removed) g USING (doc_id, i) WHERE hit IS NULL GROUP BY l.doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, [x FOR x IN string_split_regex(piece, '[ \x09]+') IF x <> ''] AS w FROM pieces
), grams AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM words
  UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM words
  UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM words
), f AS (
  SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY lang, k, phrase
), totals AS (
  SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS w, n AS a FROM f WHERE k >= 2 AND n >= 10
), parts AS (
  SELECT lang, phrase, k, a, 1 AS j, w[1] AS first, array_to_string(w[2:k], ' ') AS rest FROM candidates
  UNION ALL SELECT lang, phrase, k, a, 2, w[1] || ' ' || w[2], w[3] FROM candidates WHERE k = 3
), cuts AS (
  SELECT p.lang, p.phrase, p.k, p.a, p.j, x.n AS l, y.n AS r, (1000000::HUGEINT * p.a * p.a) // (x.n::HUGEINT * y.n) AS score
  FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = p.first JOIN f y ON y.lang = p.lang AND y.phrase = p.rest
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS longest FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM candidates WHERE k = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM candidates WHERE k = 3) GROUP BY lang, phrase
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN longer ON longer.lang = b.lang AND longer.phrase = b.phrase
  WHERE b.k = 3 OR longest IS NULL OR 100 * longest < 50 * b.a
)
SELECT ranked.lang, rank, phrase, a, l, r, totals.n AS n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_phrase_automata": OP13_SQL, "op10_shingle_join": OP10_SQL, "op12_seed_extend_dedup": OP12_SQL}
