"""One query per training-data operator, with production parameters over whole tables."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm import chat, decontamination, divergence, language, licenses, packing, periodic, quality, repeats, similarity, tokens, topk, toxicity
from storelens.llm.common import new_folder, remainder_of_id, table, texts_of


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark)
    shards = tokens.write_token_files(table(spark, sf_dir, "documents"), folder)
    return tokens.read_documents(spark, folder, shards)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder_of_id(5) == 0)
    model = toxicity.train(docs.where(~F.col("held_out")), table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, 0.5, "doc_id", "held_out")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.near_duplicates(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), "doc_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder_of_id(3) == 1)
    model = language.train(docs.where(~F.col("held_out")))
    return language.predict_languages(docs, model, "doc_id", "held_out")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder_of_id(5) == 0)
    model = quality.train(docs.where(~F.col("held_out")), table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, 0.3, "doc_id", "held_out")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    more = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.format_conversations(conversations.unionByName(more))


def op11_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `remove_repeats`, but a row carries its text's digest rather than its text to the join."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", repeats.digest(F.col("text")).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("own"))
    changed = repeats.changed_texts(docs).select("digest", "n_removed", "n_spans", F.sha2("kept", 256).alias("left"))
    return rows.join(changed, "digest", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("left", "own").alias("kept_sha256"),
    )


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def _with_planted_runs(batch: pa.RecordBatch) -> pa.Array:
    """The texts, a tenth of them with words that repeat from some place on, as their doc_id says."""
    texts = texts_of(batch).to_pylist()
    for row, doc_id in enumerate(batch.column("doc_id").to_pylist()):
        h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
        words = texts[row].encode().split() if h % 10 == 0 else []
        if words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words[a:] = (words[a : a + p] * ((n - a) // p + 1))[: n - a]
            texts[row] = b" ".join(words).decode()
    return pa.array(texts, pa.large_string())


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.collapse_runs(table(spark, sf_dir, "documents"), "doc_id", texts=_with_planted_runs)
    # Exact fractions are compared crosswise; runs stand by start, then period, so the first of equals stays.
    best = F.expr("""
        aggregate(runs, cast(null AS struct<start:bigint,length:bigint,period:bigint>), (best, run) -> CASE
            WHEN best IS NULL OR run.length * best.period > best.length * run.period THEN run ELSE best END)
    """)
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return docs.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_packing": op2_packing,
    "op3_toxicity": op3_toxicity,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_topk": op5_topk,
    "op6_decontamination": op6_decontamination,
    "op7_licenses": op7_licenses,
    "op8_language_id": op8_language_id,
    "op9_quality": op9_quality,
    "op10_chat": op10_chat,
    "op11_repeated_bytes": op11_repeated_bytes,
    "op12_source_divergence": op12_source_divergence,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op5_topk": """
        WITH q AS (
            SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ),
        scored AS (
            SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v::DOUBLE[], b.v::DOUBLE[])::BIGINT AS score
            FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
        ),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op12_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ),
        g AS (SELECT DISTINCT lang, source FROM d),
        w AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
        kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
        v AS (SELECT g.lang, count(term) AS v FROM (SELECT DISTINCT lang FROM g) g LEFT JOIN kept USING (lang) GROUP BY g.lang),
        c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
        t AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
        p AS (
            SELECT t.lang, t.source, k.term, coalesce(n, 0) AS n,
                1 + 1000000000::HUGEINT * (coalesce(n, 0) + 5) // (total + 5 * v) AS p
            FROM t JOIN v USING (lang) JOIN kept k ON k.lang = t.lang
            LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
        ),
        q AS (
            SELECT k.lang, k.term, 1 + 1000000000::HUGEINT * (coalesce(sum(n), 0) + 5) // (any_value(total) + 5 * any_value(v)) AS q
            FROM kept k JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS total FROM t GROUP BY lang) USING (lang)
            LEFT JOIN c USING (lang, term) GROUP BY k.lang, k.term
        ),
        rows AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(any_value(s.f), 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN (
                SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS f
                FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL
            ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            GROUP BY a.lang, a.source, b.source
            UNION ALL
            SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
        ),
        ranked AS (
            SELECT lang, source, part, item, value::BIGINT AS value,
                row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM rows
        )
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
    """,
}
