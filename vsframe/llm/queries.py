"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vsframe.llm import bpe
from vsframe.llm.common import read_table
from vsframe.llm.context_mixing import scoring_report
from vsframe.llm.decontamination import contamination_report
from vsframe.llm.exact_dedup import exact_dedup
from vsframe.llm.langid import identify_languages
from vsframe.llm.line_dedup import line_dedup_report
from vsframe.llm.ngram_join import link_components
from vsframe.llm.pii import personal_data_report
from vsframe.llm.prefix_trie import conversation_trie
from vsframe.llm.suffix_dedup import suffix_dedup_report
from vsframe.llm.token_records import token_record_report
from vsframe.llm.warc import archive_report
from vsframe.llm.whitening import whiten_embeddings


def op1_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_report(read_table(spark, sf_dir, "documents"))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_report(read_table(spark, sf_dir, "pages"))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup_report(read_table(spark, sf_dir, "documents"))


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring_report(read_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_report(read_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(read_table(spark, sf_dir, "documents")).drop("key")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read_table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten_embeddings(read_table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(read_table(spark, sf_dir, "conversations"))


def op13_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_record_report(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_weak_supervision": op1_pii_weak_supervision,
    "op2_warc_revisits": op2_warc_revisits,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_context_mixing": op6_context_mixing,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_ngram_join": op9_ngram_join,
    "op10_language_id": op10_language_id,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_token_records": op13_token_records,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Base32 of the SHA-1: five hex digits are four letters.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {shift}) & 31) + 1, 1)"
    for i in range(8)
    for shift in (15, 10, 5, 0)
)

ORACLE_SQL: dict[str, str] = {
    "op2_warc_revisits": f"""
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
        k AS (SELECT page_id, n, {_BASE32} AS payload_digest, max(page_id) OVER (PARTITION BY h) AS keep FROM p)
        SELECT page_id, n AS payload_bytes, payload_digest,
               CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> keep THEN keep END AS refers_to FROM k""",
    "op4_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
    "op7_line_dedup": f"""
        WITH a AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
        l AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS line FROM a),
        k AS (SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
        c AS (SELECT key, max(doc_id) AS keep_id FROM k WHERE length(key) >= 20
              GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        f AS (SELECT doc_id, i, line, keep_id IS NOT NULL AND doc_id <> keep_id AS gone FROM k LEFT JOIN c USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM f GROUP BY doc_id""",
    "op8_decontamination": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")},
                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")},
                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        p AS (SELECT item_id, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i, w
              FROM b WHERE len(w) > 0),
        s AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS t FROM p),
        x AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM s)),
        h AS (SELECT doc_id, i, m, item_id FROM (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS t FROM x)
              JOIN s USING (m, t)),
        c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY 1),
        n AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
              FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h) GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op9_ngram_join": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w
              FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS t
              FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id)
        JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) c USING (doc_id)""",
    # crc32 of the decimal: a byte goes in, then eight steps (-1) of its polynomial
    "op12_prefix_trie": """
        WITH t AS (SELECT conv_id, d, n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS i FROM
              (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d,
                      length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL)),
        h AS (SELECT conv_id, conv_id - conv_id % 100 AS head,
                     xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
                         lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                         lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END),
                         4294967295) % 6 AS h
              FROM (SELECT DISTINCT conv_id FROM t)),
        r AS (SELECT h.conv_id, i, d, n FROM h JOIN t ON t.conv_id = h.head AND t.i <= h.h
              UNION ALL SELECT conv_id, i, d, n FROM t JOIN h USING (conv_id) WHERE i > h),
        s AS (SELECT conv_id, coalesce(ds, []) AS ds, coalesce(ns, []) AS ns FROM h LEFT JOIN
              (SELECT conv_id, list(d ORDER BY i) AS ds, list(n ORDER BY i) AS ns FROM r GROUP BY 1) USING (conv_id)),
        p AS (SELECT conv_id, k AS depth, array_to_string(ds[1:k], '') AS node, CASE WHEN k > 0 THEN array_to_string(ds[1:k - 1], '') END AS up,
                     coalesce(ns[k], 0) AS size, k = len(ds) AS over FROM (SELECT *, unnest(range(0, len(ds) + 1)) AS k FROM s)),
        v AS (SELECT node, depth, any_value(up) AS up, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs,
                     string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE over) AS ids FROM p GROUP BY 1, 2),
        k AS (SELECT up AS node, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY 1),
        w AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN k USING (node)),
        b AS (SELECT p.node, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * w.size)::BIGINT AS saved_tokens
              FROM w JOIN p ON p.conv_id = w.conv_id AND p.depth <= w.depth GROUP BY 1)
        SELECT w.conv_id, w.depth, a.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens,
               sha256(coalesce(w.ids, '')) AS ends_sha256
        FROM w JOIN b USING (node) LEFT JOIN v a ON a.node = w.up""",
}
