"""Peptide-shaped views over the driver's tables, for Spark and, as SQL, for DuckDB.

``pep`` cuts the residue letters of each whole document into peptides of 10 to 49 residues, the size set by the
document. ``lab`` adds the document's quality label, ``scored`` a linear score, a split and a group. ``raw`` is every
line of every document, a third of them with a header line. ``parts`` spells part names as short peptides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import RESIDUES
from ..functions.features import with_features
from ..functions.sequence import seeded_draw
from .storage import stored

BOTH_CASES = RESIDUES + RESIDUES.lower()
#: Decision threshold of the fixed linear score.
THRESHOLD = 0.5
#: Digits of a part's brand are spelled with these residues.
DIGITS = RESIDUES[:10]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, k, source_id, sequence)."""
    letters = F.upper(F.regexp_replace("text", f"[^{BOTH_CASES}]", ""))
    cut = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "source", letters.alias("s"), (10 + F.col("doc_id") % 40).cast("int").alias("w"))
    # One walk over the letters: a substr for each peptide would start anew from the text's first letter.
    rows = cut.select("doc_id", "source", F.posexplode(F.expr("regexp_extract_all(s, concat('.{1,', w, '}'), 0)")).alias("k", "sequence"))
    return rows.filter("length(sequence) >= 5").select("doc_id", "source", F.col("k").cast("long").alias("k"), F.concat_ws(":", F.col("doc_id").cast("string"), F.col("k").cast("string")).alias("source_id"), "sequence")


PEP = f"""letters AS (
    SELECT doc_id, source, upper(regexp_replace(text, '[^{BOTH_CASES}]', '', 'g')) AS s, (10 + doc_id % 40)::INT AS w
    FROM documents WHERE text IS NOT NULL
), pep AS (
    SELECT doc_id, source, k, doc_id || ':' || k AS source_id, substr(s, k * w + 1, w) AS sequence
    FROM (SELECT *, unnest(range(0, (length(s) + w - 1) // w)) AS k FROM letters)
    WHERE length(substr(s, k * w + 1, w)) >= 5
)"""


def lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pep with label."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("label"))
    return pep(spark, sf_dir).join(labels.filter("label is not null"), "doc_id")


LAB = f"""{PEP}, one_label AS (
    SELECT doc_id, max(quality) AS label FROM labels GROUP BY doc_id
), lab AS (
    SELECT pep.*, label FROM pep JOIN one_label USING (doc_id) WHERE label IS NOT NULL
)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lab with score (six decimals), split and split_group."""
    df = with_features(lab(spark, sf_dir), names=("gravy", "fraction_basic", "fraction_acidic"))
    linear = 0.6 * F.col("gravy") + 2.0 * (F.col("fraction_basic") - F.col("fraction_acidic"))
    draw = seeded_draw(F.col("sequence"), "split")
    cut = F.lit(2**32)
    # Written once: queries read it several times, and its expressions are too large to be inlined everywhere.
    return stored(df.select("doc_id", "source", "source_id", "sequence", "label", F.round(1 / (1 + F.exp(-linear)), 6).alias("score"), F.when(draw < cut * 0.6, "train").when(draw < cut * 0.8, "validation").otherwise("test").alias("split"), F.concat(F.lit("cluster_"), F.substring(F.md5("sequence"), 1, 6)).alias("split_group")))


def count_sql(residue: str) -> str:
    return f"(length(sequence) - length(replace(sequence, '{residue}', '')))"


def share_sql(group: str) -> str:
    return "((" + " + ".join(count_sql(a) for a in group) + ") / length(sequence)::DOUBLE)"


def draw_sql(key: str, seed: object) -> str:
    return f"('0x' || substr(md5('{seed}|' || {key}), 1, 8))::BIGINT"


def gravy_sql() -> str:
    from ..functions.constants import KYTE_DOOLITTLE

    return "((" + " + ".join(f"{count_sql(a)} * ({w})::DOUBLE" for a, w in KYTE_DOOLITTLE.items()) + ") / length(sequence))"


SCORED = f"""{LAB}, scored AS (
    SELECT doc_id, source, source_id, sequence, label,
           round(1e0 / (1e0 + exp(-(0.6e0 * {gravy_sql()} + 2e0 * ({share_sql('KRH')} - {share_sql('DE')})))), 6) AS score,
           CASE WHEN d < 4294967296 * 0.6 THEN 'train' WHEN d < 4294967296 * 0.8 THEN 'validation' ELSE 'test' END AS split,
           'cluster_' || substr(md5(sequence), 1, 6) AS split_group
    FROM (SELECT *, {draw_sql('sequence', 'split')} AS d FROM lab)
)"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, raw): every line in ASCII, some with a header line before it."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    text = F.regexp_replace("line", r"[^\x00-\x7F]", "")
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), F.when((F.col("doc_id") + F.col("pos")) % 3 == 0, F.concat(F.lit(">hdr\n"), text)).otherwise(text).alias("raw"))


RAW = """lines AS (
    SELECT doc_id, i - 1 AS pos, regexp_replace(line, '[^\\x00-\\x7F]', '', 'g') AS line
    FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, i)
), raw AS (
    SELECT doc_id, pos, CASE WHEN (doc_id + pos) % 3 = 0 THEN '>hdr' || chr(10) || line ELSE line END AS raw FROM lines
)"""
NORMALISED = f"""{RAW}, stripped AS (
    SELECT doc_id, pos, raw, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS t FROM raw
), bodies AS (
    SELECT *, upper(regexp_replace(CASE WHEN t[1] = '>' THEN regexp_replace(t, '^[^\\n\\r]*(\\r\\n|[\\n\\r]|$)', '') ELSE t END, '[\\s-]+', '', 'g')) AS s FROM stripped
), normalised AS (
    SELECT doc_id, pos, raw, s, CASE
        WHEN raw IS NULL THEN 'missing' WHEN t = '' THEN 'empty' WHEN s = '' THEN 'no_residues'
        WHEN NOT regexp_full_match(s, '[{RESIDUES}]+') THEN 'invalid_symbol'
        WHEN length(s) < 5 THEN 'too_short' WHEN length(s) > 200 THEN 'too_long' END AS error_code
    FROM bodies
)"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, sequence, label): name, type and brand of each part in residue letters."""
    spelled = F.translate(F.concat("p_name", "p_type", "p_brand"), "0123456789", DIGITS)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.upper(F.regexp_replace(spelled, f"[^{BOTH_CASES}]", "")).alias("sequence"), (F.col("p_size") > 25).cast("int").alias("label"))
    return rows.filter("length(sequence) >= 5")


PARTS = f"""parts AS (
    SELECT p_partkey, upper(regexp_replace(translate(p_name || p_type || p_brand, '0123456789', '{DIGITS}'), '[^{BOTH_CASES}]', '', 'g')) AS sequence,
           (p_size > 25)::INT AS label FROM part
)"""
