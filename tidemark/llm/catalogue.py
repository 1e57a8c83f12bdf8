"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .durable import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_groups

    return near_groups(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_fst import sentencepiece_table

    return sentencepiece_table(table(spark, sf_dir, "documents"), with_ids=False)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import warc_round_trip

    return warc_round_trip(table(spark, sf_dir, "pages"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_bytes

    return repeated_bytes(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_layout import html_text

    return html_text(table(spark, sf_dir, "pages"))


def op11_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .baskets import basket_rules

    return basket_rules(table(spark, sf_dir, "sale_lines"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_vectors import vector_groups

    return vector_groups(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_toxicity": op4_toxicity,
    "op5_warc": op5_warc,
    "op6_url_filter": op6_url_filter,
    "op7_neighbours": op7_neighbours,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_packing": op9_packing,
    "op10_html_text": op10_html_text,
    "op11_baskets": op11_baskets,
    "op12_resampling": op12_resampling,
    "op13_embedding_dedup": op13_embedding_dedup,
}


def _crc_table() -> list[int]:
    """The 256 remainders that a bytewise CRC-32 looks up."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op2_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, {_LOWER} AS norm FROM documents) WINDOW w AS (PARTITION BY norm)""",
    "op5_warc": """
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id > first_id THEN first_id END AS refers_to
        FROM (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest,
                     min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages)""",
    "op11_baskets": """
        WITH RECURSIVE entries AS (
            SELECT DISTINCT sale_id, item_id FROM sale_lines WHERE flag IS DISTINCT FROM 'returned' AND sale_id IS NOT NULL AND item_id IS NOT NULL
        ), whole AS (
            SELECT count(DISTINCT sale_id) AS baskets FROM entries
        ), single AS (
            SELECT item_id, list(sale_id) AS held, count(*) AS s FROM entries, whole GROUP BY item_id, baskets HAVING count(*) >= 8 AND count(*) * 2000 >= baskets
        ), near AS (
            SELECT a.item_id AS one, b.item_id AS two FROM entries a JOIN entries b ON a.sale_id = b.sale_id AND a.item_id < b.item_id, whole
            GROUP BY 1, 2, baskets HAVING count(*) >= 8 AND count(*) * 2000 >= baskets
        ), sets AS (
            SELECT [item_id] AS items, held FROM single
            UNION ALL
            SELECT list_append(items, two), list_intersect(sets.held, single.held)
            FROM sets JOIN near ON near.one = items[-1] JOIN single ON single.item_id = two, whole
            WHERE len(list_intersect(sets.held, single.held)) >= 8 AND len(list_intersect(sets.held, single.held)) * 2000 >= baskets
        ), counted AS (
            SELECT items, len(held) AS support FROM sets
        ), parted AS (
            SELECT c.items, c.support, u.item AS c, list_filter(c.items, lambda x: x <> u.item) AS rest FROM counted c, unnest(c.items) AS u(item) WHERE len(c.items) > 1
        ), closed AS (
            SELECT items, support FROM counted WHERE items NOT IN (SELECT rest FROM parted JOIN counted r ON r.items = rest WHERE r.support = parted.support)
        ), rules AS (
            SELECT p.items, p.c, r.support AS a, s.s FROM parted p JOIN counted r ON r.items = p.rest JOIN single s ON s.item_id = p.c, whole
            WHERE 100 * p.support >= 10 * r.support AND p.support * baskets > r.support * s.s
        ), told AS (
            SELECT items, count(*) AS n_rules, arg_min(c, (a, c)) AS best_item, string_agg(c || ':' || a || ':' || s, ';' ORDER BY c) AS rules FROM rules GROUP BY items
        )
        SELECT array_to_string(items, ',') AS items, len(items) AS n_items, support, coalesce(n_rules, 0) AS n_rules, best_item, sha256(coalesce(rules, '')) AS rules_sha256
        FROM closed LEFT JOIN told USING (items)""",
    "op12_resampling": f"""
        WITH table_of AS (SELECT {_crc_table()}::BIGINT[] AS t),
        words AS (
            SELECT row_number() OVER () AS n, doc_id AS id, true AS ours, {_WORDS} AS w FROM documents
            UNION ALL SELECT row_number() OVER (), item_id, false, {_WORDS} FROM benchmark
        ), grams AS (
            SELECT n, ours, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM words
        ), hashed AS (
            SELECT g, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(g))), lambda i: ('0x' || substr(hex(encode(g)), 2 * i::INT + 1, 2))::BIGINT)),
                                      lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 10000 AS bucket
            FROM (SELECT DISTINCT g FROM grams), table_of
        ), totals AS (
            SELECT bucket, sum(CASE WHEN ours THEN 1 ELSE 0 END) AS s, sum(CASE WHEN ours THEN 0 ELSE 1 END) AS t FROM grams JOIN hashed USING (g) GROUP BY bucket
        ), gain AS (
            SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE))::BIGINT AS gain FROM totals
        ), weights AS (
            SELECT n, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM grams JOIN hashed USING (g) JOIN gain USING (bucket) WHERE ours GROUP BY n
        ), scores AS (
            SELECT id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS enough,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM words LEFT JOIN weights USING (n) WHERE ours
        ), ranks AS (
            SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id) AS r, 25 * sum(enough::INT) OVER () // 100 AS drawn FROM scores
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN enough AND r <= drawn THEN r END AS rank FROM ranks""",
    "op13_embedding_dedup": """
        WITH RECURSIVE sound AS (
            SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9
        ), reached AS (
            SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
        )
        SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
        FROM embeddings LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) n ON n.a = vec_id
        LEFT JOIN (SELECT a, min(b) AS low FROM reached GROUP BY a) m ON m.a = vec_id""",
}
