"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bottomk, decontaminate, extendible, fuzzy_lines, hard_negatives, langid, multiset_hash, packing, piece_codec, prefix_trie, secrets, simple8b, windows


def importable(spark: SparkSession) -> None:
    """Where the package isn't installed, Python workers find it at the driver's path."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op2_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return simple8b.roundtrip(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op3_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.fingerprints(_documents(spark, sf_dir))


def op4_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.dedup_lines(_documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", "text")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.document_lengths(_documents(spark, sf_dir)))


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_codec.digest(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible.exact_dedup(_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + F.lit(1))
    return windows.remove_repeats(_documents(spark, sf_dir)).select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_bottomk_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.near_duplicates(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(_documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(_table(spark, sf_dir, "conversations")))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark")).drop("hits")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_simple8b, op3_multiset_fingerprint, op4_fuzzy_line_dedup, op5_best_fit_packing, op6_piece_codec, op7_exact_dedup, op8_repeated_windows, op9_bottomk_near_dedup, op10_secret_scan, op11_hard_negatives, op12_prefix_trie, op13_decontamination)
}

ORACLES = {
    "op7_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.text) AS text_sha256
        FROM t JOIN g ON t.text = g.text""",
    "op11_hard_negatives": """
        WITH e AS (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (SELECT a.uid AS anchor, a.vec_id AS anchor_id, a.label AS anchor_label, b.uid, b.vec_id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score
            FROM e a JOIN e b ON a.uid <> b.uid WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) AS place
            FROM s WHERE label = anchor_label QUALIFY place <= 5),
        n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor, place ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank
            FROM p JOIN s ON p.anchor = s.anchor WHERE s.label <> s.anchor_label AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score QUALIFY rank <= 5)
        SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n""",
    "op12_prefix_trie": r"""
        WITH t AS (SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
            len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, turn FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos FROM t),
        c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
        r AS (SELECT c.conv_id, o.k, o.words, o.pos, 0 AS own FROM c JOIN o ON o.conv_id = c.base AND o.pos <= c.h
            UNION ALL SELECT c.conv_id, o.k, o.words, o.pos, 1 FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.h),
        d AS (SELECT conv_id, words, row_number() OVER w AS depth, sha256(string_agg(k, '') OVER w) AS node FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos ROWS UNBOUNDED PRECEDING)),
        m AS (SELECT conv_id, 0 AS depth, 0 AS words, '' AS node FROM c UNION ALL SELECT conv_id, depth, words, node FROM d),
        l AS (SELECT conv_id, max(depth) AS len FROM m GROUP BY conv_id),
        g AS (SELECT depth, node, min(m.conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
            sha256(coalesce(string_agg(CASE WHEN len = depth THEN m.conv_id::VARCHAR END, ',' ORDER BY m.conv_id), '')) AS ends_sha256
            FROM m JOIN l USING (conv_id) GROUP BY depth, node),
        up AS (SELECT g.depth, g.node, a.node AS parent FROM g LEFT JOIN m a ON a.conv_id = g.conv_id AND a.depth = g.depth - 1),
        kids AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY ALL),
        f AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN kids USING (depth, node)),
        s AS (SELECT a.depth, a.node, sum((n_children = 0)::INTEGER) AS n_leaves, sum((n_convs - 1) * f.words) AS saved_tokens
            FROM f JOIN m a ON a.conv_id = f.conv_id AND a.depth <= f.depth GROUP BY a.depth, a.node)
        SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
        FROM f JOIN s USING (depth, node) JOIN up USING (depth, node) LEFT JOIN g p ON p.depth = f.depth - 1 AND p.node = up.parent""",
    "op13_decontamination": r"""
        WITH d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        i AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[k : k + 9], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS k FROM b WHERE len(w) > 0)),
        s AS (SELECT DISTINCT size FROM i),
        v AS (SELECT uid, k, size, array_to_string(w[k : k + size - 1], ' ') AS win FROM (SELECT uid, size, w, unnest(range(1, len(w) - size + 2)) AS k FROM d, s WHERE len(w) >= size)),
        hit AS (SELECT uid, k, v.size, item_id FROM v JOIN i USING (size, win)),
        n AS (SELECT uid, count(DISTINCT x) AS n_hit FROM (SELECT uid, unnest(range(k, k + size)) AS x FROM hit) GROUP BY uid),
        q AS (SELECT uid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT uid, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY uid)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (uid) LEFT JOIN q USING (uid)""",
}
