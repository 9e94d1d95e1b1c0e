"""Thin queries over the shared tables, one for each operator, and DuckDB SQL where SQL can say the same.

Each takes (spark, sf_dir), runs its operator with production parameters over the
whole table and returns the whole result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, ctw, line_dedup, negatives, packing, quality, secret_scan, sentencepiece_scan, setsketch, simhash, topk, urls
from .common import read_table

#: Rules of the url query: host, path, verdict.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
CONTROL_CASE = "<|im_end|><|im_start|>assistant ok"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their near-duplicate lines: class_id, n_linked, n_lines, n_dropped and the dropped line numbers."""
    out = line_dedup.document_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", "n_linked", "n_lines", "n_dropped", F.array_join("dropped", ",").alias("dropped_lines"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents judged by the label model over quality rules."""
    out = quality.verdicts(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every vector whose id is divisible by 20."""
    rows = topk.quantized(read_table(spark, sf_dir, "embeddings"), every_row=True)
    return topk.top_k(rows, F.col("id") % 20 == 0, 20).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded and decoded again, as digests."""
    return sentencepiece_scan.encoding_digests(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scored by context-tree weighting and by a unigram base."""
    return ctw.scores(read_table(spark, sf_dir, "documents"))


def op6_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their near-copy component, on two-word shingles at 80 percent."""
    return setsketch.near_copies(read_table(spark, sf_dir, "documents"), width=2, percent=80)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations formatted and read back, with one more that speaks in control strings."""
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_CASE).alias("text"))
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.conversation_digests(turns).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages judged by five url rules."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.filter_urls(read_table(spark, sf_dir, "pages"), rules)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' tokens packed to sequences of 1024."""
    out = packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"), with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the spans of their secrets."""
    out = secret_scan.scan(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.col("joined").alias("spans"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for the first five positives of every anchor; some labels are shifted first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.quantized(read_table(spark, sf_dir, "embeddings"), label)
    return negatives.hard_negatives(rows, F.col("id") % 50 == 0)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' fingerprints beside those of their edited texts, and how many documents lie near every hundredth."""
    return simhash.document_fingerprints(read_table(spark, sf_dir, "documents"), F.col("doc_id") % 100 == 0)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 best phrases of two to four words."""
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline at the top of the repository."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_quality_rules, op3_top_k, op4_sentencepiece, op5_lm_scores, op6_near_copies, op7_chat_format, op8_url_filter, op9_packing, op10_secret_scan, op11_hard_negatives, op12_fingerprints, op13_collocations, pipeline)
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

ORACLES: dict[str, str] = {
    "op3_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
    """,
    "op6_near_copies": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || chr(10) || w[i + 1]) END) AS g FROM w
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), l AS (
            SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2)
            JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
        ), e AS (
            SELECT a, b FROM l UNION SELECT b, a FROM l
        ), r AS (
            SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.d
        ), c AS (
            SELECT d, min(m) AS m FROM r GROUP BY d
        )
        SELECT documents.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.m AS component_id, documents.doc_id = c.m AS kept
        FROM documents LEFT JOIN n USING (doc_id) JOIN c ON c.d = documents.doc_id
    """,
    "op7_chat_format": f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{CONTROL_CASE}'), (-1, 1, 'assistant', '{CONTROL_CASE}'))
        ), f AS (
            SELECT *, regexp_replace(role, '<(\\\\*)\\|', '<\\\\\\1|', 'g') AS r, regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g') AS x FROM t
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(24 + length(r) + length(x)) AS BIGINT) AS formatted_chars,
            regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text), 's?(ua)+') AS valid
        FROM f GROUP BY conv_id
    """,
    "op8_url_filter": f"""
        WITH rules(rule_host, rule_path, verdict) AS (VALUES {_RULES}), u AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), p AS (
            SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u
        ), m AS (
            SELECT p.*, rule_host || rule_path AS rule, verdict,
                row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, rule_host || rule_path) AS k
            FROM p LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
    """,
    "op11_hard_negatives": """
        WITH v AS (
            SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
        ), s AS (
            SELECT q.k AS a, q.vec_id AS anchor_id, c.k AS k, c.vec_id AS vec_id, q.label = c.label AS same,
                CAST(coalesce(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
            FROM v q JOIN v c ON q.k <> c.k WHERE q.vec_id % 50 = 0
        ), p AS (
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, k) AS n FROM s WHERE same) WHERE n <= 5
        ), r AS (
            SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                row_number() OVER (PARTITION BY p.a, p.n ORDER BY s.score DESC, s.vec_id, s.k) AS rank
            FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
        )
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 3
    """,
    "op13_collocations": f"""
        WITH t AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
        ), w AS (
            SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM t
        ), g AS (
            SELECT lang, words, array_to_string(w[i : i + words - 1], ' ') AS phrase
            FROM (SELECT lang, w, words, unnest(range(1, len(w) - words + 2)) AS i FROM w CROSS JOIN (VALUES (1), (2), (3), (4)) k(words) WHERE len(w) >= words)
        ), f AS (
            SELECT lang, words, phrase, count(*) AS n FROM g GROUP BY ALL
        ), total AS (
            SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY lang
        ), c AS (
            SELECT lang, words, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND n >= 30
        ), inner_phrases AS (
            SELECT lang, a, array_to_string(w[i : i + k - 1], ' ') AS phrase
            FROM (SELECT lang, a, w, k, unnest(range(1, words - k + 2)) AS i FROM c JOIN (VALUES (2), (3)) s(k) ON k < words)
        ), over AS (
            SELECT lang, phrase, max(a) AS most FROM inner_phrases GROUP BY ALL
        ), kept AS (
            SELECT c.* FROM c LEFT JOIN over USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a
        ), cuts AS (
            SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS x, array_to_string(w[k + 1 :], ' ') AS y
            FROM (SELECT *, unnest(range(1, words)) AS k FROM kept)
        ), scored AS (
            SELECT cuts.lang, cuts.phrase, a, k, p.n AS l, q.n AS r, CAST(2000000 * CAST(a AS HUGEINT) // (CAST(p.n AS HUGEINT) + q.n) AS BIGINT) AS score
            FROM cuts JOIN f p ON p.lang = cuts.lang AND p.phrase = x JOIN f q ON q.lang = cuts.lang AND q.phrase = y
        ), best AS (
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS n FROM scored) WHERE n = 1
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
        )
        SELECT ranked.lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, total.n AS n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
    """,
}
