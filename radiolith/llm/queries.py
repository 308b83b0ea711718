"""The queries over the text and embedding tables: one for each operator, at production parameters, over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, codes, embed_dedup, html_main, lm, packing, phrases, quality, simhash, suffix_dedup, toxicity, warc
from .common import remainder_of_crc32, table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public tokenizer's file; ``RADIOLITH_TOKENIZERS`` names another folder that holds it."""
    folder = os.environ.get("RADIOLITH_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.in_training_folds)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(remainder_of_crc32(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted", "n_sentences", "worst_start", "worst_end", "worst_score")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(table(spark, sf_dir, "documents"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.assess(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _lloyd_sql(parts: int = codes.PARTS, entries: int = codes.ENTRIES, rounds: int = codes.ROUNDS) -> str:
    """The rounds over all rows, without differences: each is an assignment and a mean."""
    nearest = lambda r: f"""
        a{r} AS MATERIALIZED (
            SELECT c.id, c.part, min(list_sum(list_transform(range(1, len(c.v) + 1), lambda i: (c.v[i] - b.v[i]) * (c.v[i] - b.v[i])))::HUGEINT * {entries} + b.e) AS best
            FROM c JOIN b{r} b USING (part) GROUP BY c.id, c.part)"""  # noqa: E731
    steps = []
    for r in range(rounds):
        steps.append(nearest(r))
        steps.append(f"""
        m{r} AS MATERIALIZED (
            SELECT part, e, list(f ORDER BY i) AS v FROM (
                SELECT part, e, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS f FROM (
                    SELECT c.part, a.best % {entries} AS e, i, sum(c.v[i])::HUGEINT AS s, count(*) AS n
                    FROM c JOIN a{r} a USING (id, part), range(1, (SELECT max(len(v)) FROM c) + 1) t(i) GROUP BY ALL)) GROUP BY part, e),
        b{r + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m ON m.part = b.part AND m.e = b.e)""")
    return f"""
        WITH k AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS q FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(embedding) > 0),
        c AS MATERIALIZED (SELECT id, part, q[part * (len(q) // {parts}) + 1 : (part + 1) * (len(q) // {parts})] AS v FROM k, range(0, {parts}) t(part)),
        b0 AS MATERIALIZED (SELECT part, id - 1 AS e, v FROM c WHERE id <= {entries}),{",".join(steps)},{nearest(rounds)},
        o AS (SELECT id, string_agg(printf('%02x', (best % {entries})::INT), '' ORDER BY part) AS code, sum(best // {entries})::BIGINT AS error FROM a{rounds} GROUP BY id),
        d AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, e, i)) AS digest FROM (SELECT part, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM b{rounds}))
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, digest AS codebooks_sha256 FROM o JOIN k USING (id), d"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe_round_trip,
        op2_nearest_neighbours,
        op3_toxicity,
        op4_main_text,
        op5_simhash_groups,
        op6_warc_round_trip,
        op7_best_fit_packing,
        op8_embedding_near_dedup,
        op9_suffix_array_dedup,
        op10_lm_scores,
        op11_quality_rules,
        op12_vector_codes,
        op13_phrases,
        pipeline,
    )
}

ORACLES: dict[str, str] = {
    # SHA-1 in base32: the digest's 160 bits in groups of five.
    "op6_warc_round_trip": """
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, url, strlen(body) AS payload_bytes, body, unhex(sha1(body))::BIT::VARCHAR AS bits FROM p),
        g AS (SELECT body, max(page_id) AS top FROM p GROUP BY body)
        SELECT d.page_id, d.payload_bytes::BIGINT AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + 16 * substr(bits, (5 * i + 1)::INT, 1)::INT + 8 * substr(bits, (5 * i + 2)::INT, 1)::INT + 4 * substr(bits, (5 * i + 3)::INT, 1)::INT
                   + 2 * substr(bits, (5 * i + 4)::INT, 1)::INT + substr(bits, (5 * i + 5)::INT, 1)::INT, 1)), '') AS payload_digest,
               CASE WHEN d.page_id < g.top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN d.page_id < g.top THEN g.top END AS refers_to, d.url
        FROM d JOIN g USING (body)""",
    "op8_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
        c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT c.vec_id, (SELECT count(*) FROM links WHERE links.a = c.vec_id)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept
        FROM c""",
    "op12_vector_codes": _lloyd_sql(),
    "op13_phrases": r"""
        WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM t),
        totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
        grams AS (
            SELECT lang, k, unnest(list_transform(range(1, (len(w) - k + 2)::BIGINT), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
            FROM w, range(1, 4) r(k) WHERE len(w) >= k),
        f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 10),
        cuts AS (
            SELECT c.lang, c.phrase, c.k AS words, c.n AS a, j, array_to_string(string_split(c.phrase, ' ')[1:j], ' ') AS head, array_to_string(string_split(c.phrase, ' ')[j + 1:], ' ') AS rest
            FROM f c, range(1, 3) r(j) WHERE c.k >= 2 AND j < c.k),
        scored AS (
            SELECT c.*, l.n AS l, r.n AS r, ((1000000::HUGEINT * a * a) // (l.n::HUGEINT * r.n))::BIGINT AS score
            FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.head JOIN f r ON r.lang = c.lang AND r.phrase = c.rest),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        inside AS (
            SELECT lang, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase, n FROM f WHERE k = 3),
        most AS (SELECT lang, phrase, max(n) AS n FROM inside GROUP BY ALL),
        kept AS (SELECT c.* FROM lowest c LEFT JOIN most m USING (lang, phrase) WHERE c.words = 3 OR m.n IS NULL OR 100 * m.n < 50 * c.a),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, totals.n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
}
