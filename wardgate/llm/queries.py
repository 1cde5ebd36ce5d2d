"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardgate.llm import exact, hmm, lang, resample, rollup, substrings, topk, toxicity, turns, vectors
from wardgate.llm.common import ORACLES, QUERIES, crc_part, landed, new_folder, query, table  # noqa: F401
from wardgate.llm.packing import pack
from wardgate.llm.pieces import piece_digests
from wardgate.llm.simhash import near_duplicates


@query("op3_sentencepiece")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    digests = piece_digests(F.col("text"), public_tokenizers.path("piece_bpe_32k.model"))
    return table(spark, sf_dir, "documents").select("doc_id", digests.alias("d")).select("doc_id", "d.*")


@query("op2_simhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_language")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two of three folds."""
    docs = table(spark, sf_dir, "documents")
    model = lang.fit(docs.where(crc_part("doc_id", 3) != 1))
    return docs.select(
        "doc_id",
        (crc_part("doc_id", 3) == 1).alias("held_out"),
        lang.predicted(docs, "text", model).alias("p"),
    ).select("doc_id", "held_out", "p.*")


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2,048 tokens."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op5_language_model")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document, learned from nine of ten folds."""
    fold = crc_part("doc_id", 10)
    return hmm.score(table(spark, sf_dir, "documents"), train_where=fold != 0, held_where=fold == 0)


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of two of three folds."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    training = crc_part("doc_id", 3) != 1
    known = labels.where(training).select("doc_id", F.col("toxic").cast("int")).where("toxic in (0, 1)")
    learned = toxicity.learned_lexicon(docs, known, "doc_id", "text")
    rows = landed(docs.select("doc_id", toxicity.featured(docs, "text", learned).alias("f")), "features")
    model = toxicity.fitted(rows, known, learned)
    out = toxicity.scored(rows, model, "f")
    return out.select("doc_id", (crc_part("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query(
    "op9_topk",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
        FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id,
            CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
    )
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER)
        AS rank, vec_id, score FROM s QUALIFY rank <= 10
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows for each vector whose id is divisible by 100."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query(
    "op8_token_counts",
    r"""
    WITH kept AS (
        SELECT source, lang, coalesce(text, '') AS t FROM documents
        WHERE doc_id IS NOT NULL
        QUALIFY text IS NULL OR doc_id = min(doc_id) OVER (PARTITION BY text)
    )
    SELECT source, lang, 'words' AS version, count(*) AS n_docs, CAST(sum(
        len(regexp_extract_all(t, '[^\x20\x09-\x0D]*\pL[^\x20\x09-\x0D]*'))) AS BIGINT) AS n_tokens
    FROM kept GROUP BY ALL
    UNION ALL
    SELECT source, lang, 'marks', count(*), CAST(sum(
        len(regexp_extract_all(t, '\pL+|\pN+|[^\pL\pN\x20\x09-\x0D]'))) AS BIGINT)
    FROM kept GROUP BY ALL
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after inserts under two tokenizers, revised counts, deletion of repeats, and replays of all batches."""
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    counted = landed(
        docs.select(
            "doc_id", "source", "lang",
            rollup.matches(text, rollup.WORDS).alias("words"),
            rollup.matches(text, rollup.LETTER_WORDS).alias("letter_words"),
            rollup.matches(text, rollup.MARKS).alias("marks"),
        ),
        "token-counts",
    )
    gone = landed(rollup.repeats(docs), "repeats")
    batches = {
        "1-load": rollup.changes(counted, "insert", "words", F.col("words")).union(
            rollup.changes(counted, "insert", "marks", F.col("marks"))
        ),
        "2-revised": rollup.changes(counted, "revise", "words", F.col("letter_words")),
        "3-repeats": rollup.changes(gone, "delete", "words").union(rollup.changes(gone, "delete", "marks")),
    }
    kept = rollup.TokenRollup(spark, new_folder(spark, "rollup"))
    for name in (*batches, "2-revised", "1-load"):  # replays do nothing
        kept.commit(name, batches[name])
    return kept.totals()


@query("op6_substrings")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 400-byte strings."""
    return substrings.digests(table(spark, sf_dir, "documents"))


@query(
    "op7_embeddings",
    """
    WITH RECURSIVE v AS (
        SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE label IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93
    ), reach(a, b) AS (
        SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
    ), low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
    n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id,
        vec_id <= coalesce(low.b, vec_id) AS kept
    FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN low ON low.a = vec_id
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all vectors within their labels."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


@query(
    "op12_exact_dedup",
    r"""
    WITH n AS (
        SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
        FROM documents
    )
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
        row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
    FROM n WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id NULLS LAST)
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts that are equal without white space, and the row of each that stays."""
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op13_resampling")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents drawn by importance for the benchmark's word distribution."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_conversation_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation after damage to a fifth of the rows."""
    return turns.repaired(turns.damaged(table(spark, sf_dir, "conversations")))
