"""The thin queries that apply each corpus operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, html, katz, langid, licenses, mixing, packing, prefixtrie, quality, repeats, simhash, spelling, sql, topk
from .common import by_crc, table


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.main_text(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.search(rows, rows.where("vec_id % 50 = 0"), k=5).withColumnRenamed("id", "vec_id")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = quality.fit(docs, labels.where(by_crc(labels, "doc_id", 4) != 2))
    out = quality.score(docs, weights).withColumnRenamed("id", "doc_id")
    held = F.coalesce(by_crc(out, "doc_id", 4) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.copies(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.learned(docs), keep=["doc_id"])
    held = F.coalesce(by_crc(out, "doc_id", 3) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(table(spark, sf_dir, "documents"))
    at = F.transform("base_places", lambda x: x["word"])
    return out.select(F.col("id").alias("doc_id"), "n_words", F.size("base_places").cast("bigint").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), "base_labels", "labels", "score")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.group(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")



def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(prefixtrie.rebuilt(table(spark, sf_dir, "conversations")))



def op12_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return katz.perplexities(docs, by_crc(docs, "doc_id", 7) == 2, order=3).withColumnRenamed("id", "doc_id")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.words(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_exact_top_k, op3_quality_classifier, op4_mixing, op5_language_id, op6_best_fit_packing, op7_license_scan, op8_simhash_near_dedup, op9_embedding_near_dedup, op10_repeated_passages, op11_conversation_trie, op12_katz_scoring, op13_spelling_variants)}

ORACLES: dict[str, str] = {
    "op11_conversation_trie": sql.TRIE,
    "op13_spelling_variants": sql.SPELLING,
    "op2_exact_top_k": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256.0 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
            WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op9_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), link AS MATERIALIZED (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.95
        ), reach(a, b) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
        ), low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
        SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, low.component_id, e.vec_id = low.component_id AS kept
        FROM embeddings e JOIN low ON low.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
    """,
    "op10_repeated_passages": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        strings AS (SELECT doc_id, p, md5(substr(h, CAST(2 * p + 1 AS BIGINT), 400)) AS k FROM d, unnest(range(0, greatest(0, len(h) // 2 - 199))) u(p)),
        again AS (SELECT k FROM strings GROUP BY k HAVING count(*) > 1),
        hit AS (SELECT doc_id, p FROM strings SEMI JOIN again USING (k)),
        fresh AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS new FROM hit),
        numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM fresh),
        runs AS (SELECT doc_id, run, min(p) AS a, max(p) + 200 AS b FROM numbered GROUP BY doc_id, run),
        gaps AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
        cut AS (SELECT doc_id, count(*) AS n, CAST(sum(b - a) AS BIGINT) AS gone, max(b) AS last,
                string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS kept FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(n, 0) AS n_spans,
               sha256(unhex(coalesce(kept, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
        FROM d LEFT JOIN cut USING (doc_id)
    """,
}
