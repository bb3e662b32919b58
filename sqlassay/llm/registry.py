"""The numbered queries over the given tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlassay.llm import alignment, block_names, centroids, covering, fuzzy_lines, licenses, merge_automaton, packing, pieces, quotes, resampling, rules, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_documents(spark, sf_dir))
    names = F.array_join(F.transform("licenses", lambda span: span["license"]), "; ")
    return found.select("doc_id", F.size("licenses").alias("n_licenses"), names.alias("names"), F.array_max(F.transform("licenses", lambda span: span["coverage"])).alias("coverage"), "licenses")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return toxicity.scores(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.verdicts(rules.ledger(_documents(spark, sf_dir)))
    return found.select("doc_id", *rules.MEASURES[:5], "base_failed", "kept", "n_lines", "n_capitals", "failed")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_names.exact_dedup(_documents(spark, sf_dir))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id", "text", pieces.both_ways(F.col("text")).alias("coded")).select("doc_id", "text", "coded.*")
    return rows.select("doc_id", F.size("piece_ids").alias("n_pieces"), F.xxhash64("piece_ids").alias("ids_digest"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return resampling.resample(docs, resampling.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.line_classes(_documents(spark, sf_dir)).drop("doc_key")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = covering.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", covering.hex_digits("fp").alias("fingerprint"), "component_id")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.formatted(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_totals(*centroids.clusters_of(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merge_automaton.round_trip(_documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", F.expr("length(token_bytes) div 4").alias("n_tokens"), F.sha2("token_bytes", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignment.aligned(_documents(spark, sf_dir).select("doc_id", "text"))
    spelled = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    rows = alignment.numbered(rows.withColumn("groups_sha256", spelled).drop("groups"))
    return alignment.scored(rows).drop("row")


QUERIES = {
    "op1_license_scan": op1,
    "op2_toxicity": op2,
    "op3_quality_rules": op3,
    "op4_exact_dedup": op4,
    "op5_pieces": op5,
    "op6_best_fit_packing": op6,
    "op7_line_dedup": op7,
    "op8_importance_resampling": op8,
    "op9_simhash_near_dedup": op9,
    "op10_quotation_linking": op10,
    "op11_centroid_clustering": op11,
    "op12_merge_automaton": op12,
    "op13_token_alignment": op13,
}

ORACLES = {
    "op3_quality_rules": r"""WITH cut AS (SELECT doc_id, coalesce(text, '') AS text,
            regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
        wins AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS win
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM cut WHERE len(words) >= 5)),
        twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins) WHERE c > 1),
        covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) r(k) GROUP BY doc_id),
        m AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
            length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
            len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
            len(lines) AS n_lines, length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS n_capitals
            FROM cut LEFT JOIN covered USING (doc_id)),
        f AS (SELECT *, CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
            + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
            + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END
            + CASE WHEN 100 * n_capitals > 30 * word_chars THEN 64 ELSE 0 END AS failed FROM m)
        SELECT *, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept FROM f""",
    "op4_exact_dedup": """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
        doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op11_centroid_clustering": centroids.oracle(),
}
