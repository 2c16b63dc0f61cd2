"""The queries opN_<name> over the driver's tables, thin over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_crc32
from .decontamination import find_contamination
from .exact_dedup import exact_dedup
from .language_model import lm_score
from .line_dedup import dedup_lines, dedup_page_lines
from .packing import pack_documents
from .quality import fit_quality, score_quality
from .sharding import assign_shards
from .simhash import simhash_dedup
from .spelling import spelling_variants, word_counts
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .url_reputation import judge_urls, page_outcomes
from .vector_codes import label_errors, vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(id_crc32(F.col("doc_id")), F.lit(7)) == 2
    out = lm_score(table(spark, sf_dir, "documents"), training=~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "n_lines", "n_removed")


def line_dedup_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_page_lines(table(spark, sf_dir, "pages")).select("page_id", "host", "text", "n_lines", "n_removed")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(id_crc32(F.col("doc_id")), F.lit(3)) == 1
    model = fit_quality(docs, table(spark, sf_dir, "labels"), usable=~held_out)
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    judged = judge_urls(pages, page_outcomes(pages, table(spark, sf_dir, "labels")))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents"))).select("word", "form", "root", "n", "n_near", "form_n")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = label_errors(vector_codes(table(spark, sf_dir, "embeddings")))
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_lm_score, op3_line_dedup, op4_substring_dedup, op5_suffix_dedup, op6_quality, op7_decontamination, op8_url_filter, op9_packing, op10_simhash, op11_spelling_variants, op12_vector_codes, op13_sharding, line_dedup_pages)}
ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY t)""",
    "op3_line_dedup": """
        WITH lines AS (
            SELECT doc_id, source, i, line FROM (
                SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
            ), unnest(ls) WITH ORDINALITY AS u(line, i)
        ), sites AS (
            SELECT source, count(*) AS pages FROM documents GROUP BY source
        ), counts AS (
            SELECT source, line, count(DISTINCT doc_id) AS n FROM lines WHERE trim(line, ' ') <> '' GROUP BY source, line
        ), bad AS (
            SELECT c.source, c.line FROM counts c JOIN sites s ON c.source IS NOT DISTINCT FROM s.source
            WHERE c.n > 0.08 * s.pages AND c.n >= 5
        ), judged AS (
            SELECT l.*, b.line IS NOT NULL AS drop_it FROM lines l
            LEFT JOIN bad b ON l.line = b.line AND l.source IS NOT DISTINCT FROM b.source
        ), texts AS (
            SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT drop_it) AS kept,
                   count(*) AS n_lines, count(*) FILTER (WHERE drop_it) AS n_removed
            FROM judged GROUP BY doc_id
        )
        SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.kept, '') END AS text,
               coalesce(t.n_lines, 0)::INT AS n_lines, coalesce(t.n_removed, 0)::INT AS n_removed
        FROM documents d LEFT JOIN texts t ON d.doc_id = t.doc_id""",
    "line_dedup_pages": r"""
        WITH p AS (
            SELECT page_id, html IS NULL AS no_html,
                translate(regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_replace(regexp_replace(html, '[ \t\n\f\r]*(<[^>]*>[ \t\n\f\r]*)+', chr(10), 'g'), '\A\n|\n\z', '', 'g') AS text
            FROM pages
        ), lines AS (
            SELECT page_id, host, i, line FROM (SELECT page_id, host, string_split(text, chr(10)) AS ls FROM p WHERE NOT no_html), unnest(ls) WITH ORDINALITY AS u(line, i)
        ), sites AS (
            SELECT host, count(*) AS pages FROM p GROUP BY host
        ), bad AS (
            SELECT host, line FROM lines JOIN sites USING (host) WHERE trim(line, ' ') <> ''
            GROUP BY host, line, pages HAVING count(DISTINCT page_id) > 0.08 * pages AND count(DISTINCT page_id) >= 5
        ), texts AS (
            SELECT page_id, string_agg(l.line, chr(10) ORDER BY i) FILTER (WHERE b.line IS NULL) AS kept, count(*) AS n_lines, count(b.line) AS n_removed
            FROM lines l LEFT JOIN bad b ON l.line = b.line AND l.host = b.host GROUP BY page_id
        )
        SELECT p.page_id, p.host, CASE WHEN no_html THEN NULL ELSE coalesce(kept, '') END AS text, coalesce(n_lines, 0)::INT AS n_lines, coalesce(n_removed, 0)::INT AS n_removed
        FROM p LEFT JOIN texts USING (page_id)""",
    "op4_substring_dedup": r"""
        WITH words AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
        ), windows AS (
            SELECT doc_id, p, array_to_string(ws[p:p + 49], ' ') AS w FROM words, unnest(range(1, len(ws) - 48)) AS u(p)
        ), firsts AS (
            SELECT hash(w) AS a, md5_number(w) AS b, min(doc_id) AS first FROM windows GROUP BY 1, 2 HAVING min(doc_id) < max(doc_id)
        ), gone AS (
            SELECT DISTINCT doc_id, k FROM windows JOIN firsts ON hash(w) = a AND md5_number(w) = b AND doc_id > first, unnest(range(p, p + 50)) AS v(k)
        ), lists AS (
            SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id
        )
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed,
               sha256(array_to_string(CASE WHEN ks IS NULL THEN ws ELSE list_filter(ws, lambda w, i: NOT list_contains(ks, i)) END, ' ')) AS kept_sha256
        FROM words LEFT JOIN lists USING (doc_id)""",
    "op8_url_filter": r"""
        WITH p AS (
            SELECT page_id,
                translate(regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)([^?#]*)', 2) AS path
            FROM pages
        ), y AS (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
        ), h0 AS (
            SELECT host, count(*)::DOUBLE AS n, sum(good)::DOUBLE AS k
            FROM p JOIN y ON y.doc_id = try_cast(regexp_extract(path, '/(\d+)[^/]*$', 1) AS BIGINT) GROUP BY host
        ), h AS (
            SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix FROM h0
        ), s0 AS (
            SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 1) / (sum(n) + 2) FROM h) AS mean FROM h GROUP BY suffix
        ), s AS (SELECT *, (SELECT STRENGTH FROM s0) AS st FROM s0
        ), d0 AS (
            SELECT h.domain, h.suffix, sum(h.n) AS n, sum(h.k) AS k FROM h GROUP BY 1, 2
        ), d1 AS (
            SELECT d0.domain, d0.n, d0.k, (s.k - d0.k + s.st * s.mean) / (s.n - d0.n + s.st) AS mean FROM d0 JOIN s USING (suffix)
        ), d AS (SELECT *, (SELECT STRENGTH FROM d1) AS st FROM d1
        ), o0 AS (
            SELECT h.host, h.n, h.k, (d.k - h.k + d.st * d.mean) / (d.n - h.n + d.st) AS mean FROM h JOIN d USING (domain)
        ), o AS (
            SELECT host, k + st * mean AS a, n - k + st * (1 - mean) AS b FROM (SELECT *, (SELECT STRENGTH FROM o0) AS st FROM o0)
        ), judged AS (
            SELECT p.*, CASE
                WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'allow example.com/en/7'
                WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'block example.net/de/8'
                WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'block com/en/'
                WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'allow net/de/'
                WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'block org/es/' END AS r
            FROM p
        )
        SELECT page_id, host, path, substr(r, 7) AS rule,
            CASE WHEN r IS NOT NULL THEN substr(r, 1, 5)
                 WHEN a / (a + b) + 1.645e0 * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) < 0.5e0 THEN 'block' ELSE 'allow' END AS verdict
        FROM judged LEFT JOIN o USING (host)""".replace(
        "STRENGTH",
        """CASE WHEN sum(n * (n - 1) * mean * (1 - mean)) > 0 AND sum(pow(k - n * mean, 2)) > sum(n * mean * (1 - mean))
            THEN least(greatest(sum(n * (n - 1) * mean * (1 - mean)) / (sum(pow(k - n * mean, 2)) - sum(n * mean * (1 - mean))) - 1, 1e0), 1e3) ELSE 1e3 END""",
    ),
}

#: crc32 in SQL: a table of 256 by its rule, then a step a byte. ``crc32_of('x')`` needs the CTE crc_table.
CRC_TABLE = """crc_table AS (
    SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crcs)"""


def crc32_of(text: str) -> str:
    byte = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce({byte}, lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


ORACLES["op11_spelling_variants"] = rf"""
    WITH RECURSIVE {CRC_TABLE}, runs AS (
        SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
    ), hashed AS (
        SELECT run, {crc32_of("id || ':' || run")} AS h FROM runs, crc_table WHERE length(run) >= 7
    ), vocabulary AS (
        SELECT word, count(*) AS n FROM (
            SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed
        ) WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2
    ), cut AS (
        SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)
    ), near AS (
        SELECT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN vocabulary b ON a.rest = b.word
        UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN vocabulary b ON a.rest = b.word
    ), best AS (
        SELECT word, any_value(n) AS n, count(*) AS n_near, arg_min(other, (-m, other)) AS form, max(m) AS form_n FROM near GROUP BY word
    ), forms AS (
        SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * v.n THEN form END AS form, CASE WHEN form_n >= 10 * v.n THEN form_n END AS form_n FROM vocabulary v LEFT JOIN best USING (word)
    ), chain AS (
        SELECT word, word AS here, 0 AS k FROM forms
        UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN forms f ON f.word = c.here WHERE f.form IS NOT NULL
    ), roots AS (SELECT word, arg_max(here, k) AS root FROM chain GROUP BY word)
    SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)"""


def _lloyd_sql(rounds: int = 2) -> str:
    """The CTEs b0..b<rounds> (part, entry, k, x) and a0..a<rounds> (id, part, entry, d): plain rounds, every distance measured."""
    out = ["b0 AS (SELECT part, r - 1 AS entry, k, x FROM firsts JOIN whole USING (id))"]
    for i in range(rounds + 1):
        out.append(f"a{i} AS (SELECT id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT id, w.part, entry, sum((w.x - b.x) * (w.x - b.x))::BIGINT AS d FROM whole w JOIN b{i} b ON w.part = b.part AND w.k = b.k GROUP BY ALL) GROUP BY id, part)")
        if i < rounds:
            out.append(f"m{i} AS (SELECT part, entry, k, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x FROM a{i} JOIN whole USING (id, part) GROUP BY ALL)")
            out.append(f"b{i + 1} AS (SELECT b.part, b.entry, b.k, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN m{i} m USING (part, entry, k))")
    return ", ".join(out)


ORACLES["op12_vector_codes"] = f"""
    WITH kept AS (
        SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id, vec_id, label, embedding FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), whole AS (
        SELECT id, (i - 1) // (len(embedding) // 16) AS part, (i - 1) % (len(embedding) // 16) AS k, floor(256e0 * embedding[i]::DOUBLE)::BIGINT AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM kept)
    ), firsts AS (SELECT id, id AS r FROM kept WHERE id <= 64
    ), {_lloyd_sql()}, coded AS (
        SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY id
    ), sums AS (SELECT label, sum(error)::BIGINT AS label_error FROM coded JOIN kept USING (id) GROUP BY label)
    SELECT vec_id, code, error, label_error, sha256((SELECT string_agg(x::VARCHAR, ',' ORDER BY part, entry, k) FROM b2)) AS codebooks_sha256
    FROM coded JOIN kept USING (id) JOIN sums ON kept.label IS NOT DISTINCT FROM sums.label"""

ORACLES["op13_sharding"] = f"""
    WITH {CRC_TABLE}, rows_of AS (
        SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size, {crc32_of("coalesce(text, '')")} AS text_crc32, substr(md5('42|' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS key FROM documents, crc_table
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY key, doc_id NULLS LAST, text_crc32, size) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM rows_of
    ), placed AS (
        SELECT *, row_number() OVER (ORDER BY (2 * r + 1)::DOUBLE / (2 * n)::DOUBLE, source NULLS LAST, key, doc_id NULLS LAST, text_crc32, size) - 1 AS p, (SELECT count(*) FROM rows_of) AS total FROM ranked
    )
    SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (p * 8 // total)::INT AS shard, p - (p * 8 // total * total + 7) // 8 AS slot, NULL::INT AS grown_shard FROM placed"""
