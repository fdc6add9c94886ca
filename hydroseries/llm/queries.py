"""One query for each operator over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, edit_embedding, hmm, importance, language_id, mixing, piece_lattice, secret_scan, simhash, substring_dedup, url_rules, variants, vector_forest
from .common import held_out, write_shared

URL_RULES = [url_rules.UrlRule("net/", "block"), url_rules.UrlRule("example.net/en/", "allow"), url_rules.UrlRule("example.com/de/", "block"), url_rules.UrlRule("org/fr/", "allow")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~held_out(F.col("doc_id"), 3, 1)).select("doc_id", "text", "lang"))
    found = language_id.label(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.size("lang_spans").alias("n_spans"))


def op2_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = write_shared(edit_embedding.compare_with_edited(_table(spark, sf_dir, "documents")), "compared")
    return edit_embedding.near_groups(compared)


def op3_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hmm.score(_table(spark, sf_dir, "documents"), ~held_out(F.col("doc_id"), 5, 1))
    return found.withColumn("held_out", held_out(F.col("doc_id"), 5, 1))


def op4_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = piece_lattice.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), n=4)
    read = piece_lattice.round_trips(made)
    return read.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids", "scores", "changes",
        "round_trips", F.forall("round_trips", lambda x: x).alias("round_trip"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, radius=2)


def op6_vector_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_forest.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)
    return found.withColumnRenamed("id", "vec_id")


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "confidence")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(planted).alias("text"))
    made = chat.format_turns(chat.turns_of_rows(rows.unionByName(extra))).select("conv_id", "formatted", "loss_spans")
    read = made.withColumn("turns", chat.parse_formatted(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP8_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, 2 * length(text) - length(replace(replace(replace(text, '~', ''), '<', ''), '[', '')) AS body,
         2 * length(role) - length(replace(replace(replace(replace(role, '~', ''), '<', ''), '[', ''), chr(10), '')) AS head
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(8 + head + 1 + body + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.deduplicate(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, i, list_slice(ws, i, i + 12) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)
), m AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g),
cov AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN m USING (g) WHERE first < doc_id
), tok AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS t FROM w),
kept AS (
  SELECT tok.doc_id, string_agg(t, ' ' ORDER BY tok.p) AS k, count(*) AS n FROM tok ANTI JOIN cov ON tok.doc_id = cov.doc_id AND tok.p = cov.p GROUP BY tok.doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""


def op10_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(_table(spark, sf_dir, "documents"))[0]


OP10_SQL = """
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, 1.0::DOUBLE * (SELECT sum(n) FROM n)::DOUBLE / ((SELECT count(*) FROM n)::DOUBLE * n) AS rate FROM n),
m AS (SELECT source, rate, greatest(ceil(rate / 16.0::DOUBLE), 1)::INT AS parts FROM r),
terms AS (
  SELECT source, 0 AS k, rate / parts AS mean, exp(-(rate / parts)) AS p, exp(-(rate / parts)) AS cdf FROM m
  UNION ALL SELECT source, k + 1, mean, p * mean / (k + 1), cdf + p * mean / (k + 1) FROM terms WHERE k < 64
),
draws AS (
  SELECT d.*, m.rate, i.i, ('0x' || substr(md5('17|' || coalesce(d.doc_id::VARCHAR, 'null') || '|' || i.i), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN m ON d.source IS NOT DISTINCT FROM m.source, generate_series(1, m.parts) AS i(i)
),
counted AS (
  SELECT doc_id, text, lang, d.source, n_chars, rate, sum((SELECT count(*) FROM terms t WHERE t.source IS NOT DISTINCT FROM d.source AND d.u >= t.cdf)) AS c
  FROM draws d GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, rate AS mix_rate, j.j::INT AS copy_no FROM counted, generate_series(1, c::BIGINT) AS j(j)
"""


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = variants.count_words(_table(spark, sf_dir, "documents"), misspell=31)
    return variants.group_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == secret_scan.KINDS.index(kind))).cast("bigint").alias(f"n_{kind}")
    base = F.sha2(secret_scan.spans_text(F.col("base")), 256).alias("base_sha256")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), base, secret_scan.spans_text(F.col("secrets")).alias("spans"), "n_random")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.draw(docs, _table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_edit_embedding": op2_edit_embedding,
    "op3_hmm": op3_hmm,
    "op4_piece_lattice": op4_piece_lattice,
    "op5_simhash": op5_simhash,
    "op6_vector_forest": op6_vector_forest,
    "op7_url_rules": op7_url_rules,
    "op8_chat_format": op8_chat_format,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_poisson_mixing": op10_poisson_mixing,
    "op11_variants": op11_variants,
    "op12_secret_scan": op12_secret_scan,
    "op13_importance": op13_importance,
}
ORACLE_SQL = {"op8_chat_format": OP8_SQL, "op9_substring_dedup": OP9_SQL, "op10_poisson_mixing": OP10_SQL}
