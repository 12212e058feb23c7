"""One query for each operator, over whole tables, with production parameters, and the SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .block_names import block_name_dedup
from .decontaminate import contamination
from .language_masks import fit_languages, identify
from .katz import fit_and_score
from .mixing import mix
from .prefix_trie import prefix_trie
from .repeats import remove_repeats
from .simhash import simhash_components
from .token_counts import token_counts
from .token_store import read_store, write_store
from .toxic_spans import fit_toxic, score_toxic
from .treaps import build_index, search
from .warc_zip import read_packages, write_packages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int):
    """crc32 of the id as text modulo ``n``; 0 for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n, F.lit(0))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_name_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxic(docs, labels.filter(remainder(5) != 0))
    scored = score_toxic(docs, model)
    return scored.select(
        "doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans")
    )


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.filter(remainder(4) != 2))
    return identify(docs, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op4_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = write_packages(table(spark, sf_dir, "pages"))
    records = read_packages(spark, packages, with_payload=False)
    return records.select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_store(write_store(table(spark, sf_dir, "documents")), with_ids=False).drop("ids")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return found.withColumn("repeats", F.col("n_removed") > 0)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, scores = fit_and_score(docs, remainder(7) != 2)
    return scores.select(
        "doc_id", (remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_toxicity,
        op3_language,
        op4_warc_packages,
        op5_token_counts,
        op6_mixing,
        op7_simhash,
        op8_token_store,
        op9_decontamination,
        op10_repeats,
        op11_prefix_trie,
        op12_lexical_search,
        op13_lm_scoring,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Unsigned CRC-32 of the decimal conv_id, one bit at a time; -1 stands for a bit.
_CRC32 = """(xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda d: [ord(d), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)))"""
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER} AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM t
    """,
    "op4_warc_packages": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        q AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first > page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first > page_id THEN first END AS refers_to
        FROM q
    """,
    "op11_prefix_trie": f"""
        WITH t AS (SELECT conv_id, turn, length(coalesce(text, ''))::BIGINT AS size, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS digest
                   FROM conversations WHERE conv_id IS NOT NULL),
        p AS (SELECT conv_id, digest, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS pos FROM t),
        c AS (SELECT conv_id, conv_id - conv_id % 100 AS first, {_CRC32} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
        r AS (SELECT c.conv_id, 0 AS part, pos, digest, size FROM c JOIN p ON p.conv_id = c.first WHERE pos < h
              UNION ALL SELECT c.conv_id, 1, pos, digest, size FROM c JOIN p USING (conv_id) WHERE pos >= h),
        s AS (SELECT conv_id, digest, size, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM r),
        o AS (SELECT conv_id, depth, size, sha256(string_agg(digest, ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM s),
        w AS (SELECT conv_id, 0 AS depth, 0 AS size, 'root' AS node, NULL AS above FROM c
              UNION ALL SELECT conv_id, depth, size, node, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), 'root') FROM o),
        n AS (SELECT node, any_value(above) AS above, any_value(depth)::BIGINT AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size FROM w GROUP BY node),
        k AS (SELECT above AS node, count(*) AS n_children FROM n WHERE above IS NOT NULL GROUP BY 1),
        m AS (SELECT n.*, coalesce(n_children, 0)::BIGINT AS n_children FROM n LEFT JOIN k USING (node)),
        sums AS (SELECT a.node, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.size)::BIGINT AS saved_tokens
                 FROM m u JOIN w uw ON uw.node = u.node AND uw.conv_id = u.conv_id JOIN w a ON a.conv_id = u.conv_id AND a.depth <= u.depth GROUP BY 1),
        tops AS (SELECT conv_id, max(depth) AS depth FROM w GROUP BY 1),
        ends AS (SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM w JOIN tops USING (conv_id, depth) GROUP BY 1)
        SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
        FROM m JOIN sums USING (node) LEFT JOIN ends USING (node) LEFT JOIN m u ON u.node = m.above
    """,
    "op12_lexical_search": f"""
        WITH tokens AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM documents),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY 1, 2),
        sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY 1),
        whole AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
        w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term, n_docs),
        asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM benchmark),
        scored AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
            FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN sizes USING (doc_id), whole GROUP BY 1, 2),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
}
