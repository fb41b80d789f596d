"""The registered queries of this subpackage: thin, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import decontaminate, fill_middle, html_text, language_id, pii, quality, sentencepiece_codec, simhash, token_alignment, token_counts, toxicity, vector_search, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark, sf_dir):
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op2_quality(spark, sf_dir):
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_warc(spark, sf_dir):
    out = warc.round_trip(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_html_text(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.fit(pages))


def op5_simhash(spark, sf_dir):
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_vector_search(spark, sf_dir):
    return vector_search.top_k(_table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_decontaminate(spark, sf_dir):
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_pii(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    found = pii.detect(docs, pii.fit(docs))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op10_sentencepiece(spark, sf_dir):
    out = sentencepiece_codec.sentencepiece_codec(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_fill_middle(spark, sf_dir):
    out = fill_middle.fill_middle(_table(spark, sf_dir, "documents"))
    return out.withColumn("output_sha256", F.sha2("output", 256)).withColumn("restored_sha256", F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256)).drop("output")


def op12_token_alignment(spark, sf_dir):
    a, b = _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model")
    aligned = token_alignment.align(_table(spark, sf_dir, "documents"), a, b)
    digest = F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    return token_alignment.with_counts(aligned.select("*", digest).drop("groups"), a, b)


def op13_language_id(spark, sf_dir):
    return language_id.languages(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_quality": op2_quality,
    "op3_warc": op3_warc,
    "op4_html_text": op4_html_text,
    "op5_simhash": op5_simhash,
    "op6_vector_search": op6_vector_search,
    "op7_toxicity": op7_toxicity,
    "op8_decontaminate": op8_decontaminate,
    "op9_pii": op9_pii,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_fill_middle": op11_fill_middle,
    "op12_token_alignment": op12_token_alignment,
    "op13_language_id": op13_language_id,
}

ORACLES: dict[str, str] = {
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        d AS (SELECT *, list_transform(range(0, 40), lambda i: strpos('0123456789abcdef', substr(h, CAST(i AS INT) + 1, 1)) - 1) AS nibbles, min(page_id) OVER (PARTITION BY h) AS least FROM p)
        SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST(((nibbles[CAST((5 * k) // 4 AS INT) + 1] * 16 + nibbles[CAST((5 * k) // 4 AS INT) + 2]) // CAST(pow(2, 3 - (5 * k) % 4) AS BIGINT)) % 32 AS INT) + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = least THEN NULL ELSE least END AS refers_to
        FROM d""",
    "op6_vector_search": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
              FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_fill_middle": """
        WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units FROM documents),
        x AS (SELECT *, len(units) AS n, list_transform(range(0, 4), lambda i: CAST('0x' || substr(d, CAST(8 * i + 1 AS INT), 8) AS BIGINT)) AS r FROM h),
        k AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS k1, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS k2,
                     CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
        p AS (SELECT *, array_to_string(units[1:k1], '') AS prefix, array_to_string(units[k1 + 1:k2], '') AS middle, array_to_string(units[k2 + 1:], '') AS suffix FROM k)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
}
