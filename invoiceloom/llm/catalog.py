"""Registered queries ``opN_<name>``: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from invoiceloom.llm import (
    byte_bpe, chat_roles, embedding_dedup, lexical_search, license_scan, line_dedup, mixing, ngram_join, packing, quality_classifier, quality_rules, warc, whitening,
)
from invoiceloom.llm.labelled import held_out
from invoiceloom.llm.rows import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_chat_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_roles.repaired(table(spark, sf_dir, "conversations"))
    return turns.select("conv_id", "turn", "action", "new_role", "inserted", "cost", F.sha2("segment", 256).alias("segment_sha256"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    matches = F.col("license_matches")
    names = F.array_join(F.array_sort(F.array_distinct(matches["license"])), ",")
    best = F.array_max(matches["dice"])
    return found.select(
        "doc_id", F.size(matches).cast("long").alias("n_matches"), names.alias("licenses"), F.round(best, 6).alias("best_dice")
    )


def op3_license_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    runs = F.col("license_passages")
    names = F.array_join(F.array_sort(F.array_distinct(runs["license"])), ",")
    best = F.array_max(runs["dice"])
    return found.select(
        "doc_id", F.size(runs).cast("long").alias("n_passages"), names.alias("licenses"), F.round(best, 6).alias("best_dice")
    )


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.drop_shared_lines(documents)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokenizer("byte_bpe_50k.tiktoken")
    ids = byte_bpe.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    decoded = byte_bpe.decoder(path)(F.col("ids"))
    return ids.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.train(documents, table(spark, sf_dir, "labels"))
    score = quality_classifier.quality_score(model, F.col("text"))
    scored = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality_classifier.THRESHOLD).cast("int"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "op8-warc")
    warc.write_warc(warc.plan_records(table(spark, sf_dir, "pages")), path)
    return warc.read_records(spark, path)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.packed_documents(documents, tokenizer("word_bpe_49k.json"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.train(documents, table(spark, sf_dir, "labels"))
    return quality_rules.with_rules(documents, model).drop("text")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_chat_roles": op2_chat_roles,
    "op3_license_scan": op3_license_scan,
    "op3_license_passages": op3_license_passages,
    "op4_line_dedup": op4_line_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_warc": op8_warc,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_quality_rules": op10_quality_rules,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_source_mixing": op12_source_mixing,
    "op13_lexical_search": op13_lexical_search,
}

BLANK_CHARACTERS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


TEMPLATE_ROWS = ", ".join(
    f"({i}, {quoted(name)}, {license_scan.template_bigrams(text)!r})" for i, (name, text) in enumerate(license_scan.TEMPLATES)
)

ORACLES: dict[str, str] = {
    "op4_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
        keyed AS (SELECT *, translate(trim(line, {BLANK_CHARACTERS}), {LOWER}) AS key FROM lines),
        shared AS (
            SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
            GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        marked AS (
            SELECT k.doc_id, k.line, k.pos, s.key IS NOT NULL AND s.keeper <> k.doc_id AS gone
            FROM keyed k LEFT JOIN shared s USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op8_warc": """
        WITH hashed AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        grouped AS (
            SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS hex,
                max(page_id) OVER (PARTITION BY payload) AS largest FROM hashed)
        SELECT page_id, payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + (CAST('0x' || substr(hex, 1 + 5 * CAST(i // 4 AS INTEGER), 5) AS INTEGER)
                    >> (15 - 5 * CAST(i % 4 AS INTEGER))) % 32, 1)), '') AS payload_digest,
            CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> largest THEN largest END AS refers_to
        FROM grouped""",
    "op3_license_scan": f"""
        WITH templates(number, license, grams) AS (VALUES {TEMPLATE_ROWS}),
        units AS (
            SELECT doc_id, unnest(CASE WHEN len(parts) > 1 THEN list_prepend(body, parts) ELSE parts END) AS unit
            FROM (SELECT doc_id, coalesce(text, '') AS body, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
        worded AS (
            SELECT doc_id, list_filter(string_split(regexp_replace(translate(unit, {LOWER}),
                '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda w: w <> '') AS words FROM units),
        bigrams AS (
            SELECT doc_id, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS own
            FROM worded WHERE len(words) > 1),
        scored AS (
            SELECT b.doc_id, t.license, 2.0 * len(list_intersect(b.own, t.grams)) / (len(b.own) + len(t.grams)) AS dice
            FROM bigrams b JOIN templates t
                ON 75 * len(b.own) <= 125 * len(t.grams) AND 75 * len(t.grams) <= 125 * len(b.own)),
        matched AS (SELECT * FROM scored WHERE 100 * dice >= 75)
        SELECT d.doc_id, count(m.license) AS n_matches,
            coalesce(array_to_string(list_sort(list_distinct(list(m.license) FILTER (m.license IS NOT NULL))), ','), '') AS licenses,
            round(max(m.dice), 6) AS best_dice
        FROM documents d LEFT JOIN matched m USING (doc_id) GROUP BY d.doc_id""",
    "op1_embedding_dedup": """
        WITH RECURSIVE sound AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
            SELECT a.vec_id AS u, b.vec_id AS v FROM sound a JOIN sound b
                ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
        reached(a, b) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.v FROM reached r JOIN links l ON r.b = l.u),
        counted AS (SELECT u, count(*) AS n FROM links GROUP BY u)
        SELECT a AS vec_id, coalesce(max(n), 0) AS n_links, min(b) AS component_id, a = min(b) AS kept
        FROM reached LEFT JOIN counted ON a = u GROUP BY a""",
    "op6_ngram_jaccard_join": f"""
        WITH RECURSIVE worded AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
            FROM worded),
        parts AS (SELECT doc_id, unnest(s) AS x FROM sets),
        shared AS (
            SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM parts a JOIN parts b ON a.x = b.x AND a.doc_id < b.doc_id
            GROUP BY ALL),
        near AS (
            SELECT u, v FROM shared JOIN sets p ON u = p.doc_id JOIN sets q ON v = q.doc_id
            WHERE 100 * n >= 75 * (len(p.s) + len(q.s) - n)),
        links AS (SELECT u, v FROM near UNION ALL SELECT v, u FROM near),
        reached(a, b) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.v FROM reached r JOIN links l ON r.b = l.u),
        least_of AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
        SELECT s.doc_id, len(s.s) AS n_shingles, component_id FROM sets s JOIN least_of ON s.doc_id = a""",
    "op13_lexical_search": f"""
        WITH terms AS (
            SELECT doc_id, row_number() OVER () AS doc, len(w) AS n, w
            FROM (SELECT doc_id, regexp_extract_all(translate(text, {LOWER}), '{lexical_search.TERM}') AS w FROM documents) WHERE len(w) > 0),
        totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS all_terms FROM terms),
        wanted AS (
            SELECT item_id, term, count(*) AS times
            FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, {LOWER}), '{lexical_search.TERM}')) AS term FROM benchmark) GROUP BY ALL),
        counted AS (
            SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(w) AS term FROM terms)
            WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
        weighed AS (
            SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
            FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), totals),
        impacts AS (
            SELECT doc, doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // all_terms)) AS impact
            FROM counted JOIN terms USING (doc), totals),
        scored AS (
            SELECT item_id, doc, doc_id, CAST(sum(times * w * impact) AS BIGINT) AS score
            FROM wanted JOIN weighed USING (term) JOIN impacts USING (term) GROUP BY ALL)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM scored WHERE score > 0 QUALIFY rank <= {lexical_search.BEST}""",
}
