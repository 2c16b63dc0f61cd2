"""Screening rules, audits and the fixed tables that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import is_canonical

# Topic, resource, kind of evidence, year, address and use of each library entry.
LIBRARY = (
    ("Global health context", "WHO antimicrobial resistance fact sheet", "Authoritative public-health source", "2026", "https://www.who.int/news-room/fact-sheets/detail/antimicrobial-resistance", "Current AMR burden, resistance prevalence, and R&D context."),
    ("Global health context", "WHO bacterial priority pathogens list", "Authoritative priority-setting report", "2024", "https://www.who.int/publications/i/item/9789240093461", "Frames the bacterial targets for which new interventions are most urgent."),
    ("Positive data", "Antimicrobial Peptide Database", "Curated biological database", "Current release", "https://aps.unmc.edu/downloads", "Source of curated AMP sequences; release and download date must be recorded."),
    ("Activity and safety data", "DBAASP", "Manually curated experimental database", "Current release", "https://dbaasp.org/home", "Target-specific activity, assay conditions, structure, hemolysis, and cytotoxicity."),
    ("Putative-negative data", "UniProt website API", "Primary database/API publication", "2025", "https://doi.org/10.1093/nar/gkaf394", "Reproducible retrieval of reviewed protein records and provenance metadata."),
    ("Protein language models", "ESM-2", "Primary methods paper", "2023", "https://doi.org/10.1126/science.ade2574", "Frozen contextual sequence representations for the modern comparison model."),
    ("Benchmark validity", "Negative-data bias in AMP prediction", "Primary benchmarking study", "2022", "https://doi.org/10.1093/bib/bbac343", "Shows why negative-set construction can materially alter apparent performance."),
    ("Biological ML reporting", "DOME recommendations", "Community reporting recommendations", "2021", "https://doi.org/10.1038/s41592-021-01205-4", "Data, Optimization, Model, and Evaluation transparency for biological ML."),
    ("Clinical translation", "TRIPOD+AI", "Clinical prediction reporting guideline", "2024", "https://doi.org/10.1136/bmj-2023-078378", "Relevant only if the work becomes an individual-level clinical prediction study."),
    ("Clinical translation", "PROBAST+AI", "Clinical prediction risk-of-bias tool", "2025", "https://doi.org/10.1136/bmj-2024-082505", "Relevant to quality and applicability assessment in a clinical prediction context."),
)
LIBRARY_COLUMNS = ("topic", "resource", "evidence_type", "year", "url", "use")

# Endpoint, status, required evidence, interpretation.
EVIDENCE = (
    ("AMP-like sequence pattern", "Estimated", "Validated binary classifier", "Prioritization signal only"),
    ("Target-species potency", "Not evaluated", "MIC/MBC under specified assay conditions", "Cannot infer susceptible organism or dose"),
    ("Antimicrobial spectrum", "Not evaluated", "Panel of target strains", "Binary AMP labels do not define spectrum"),
    ("Hemolysis / cytotoxicity", "Not evaluated", "HC50/CC50 and relevant cell assays", "Activity without selectivity is not a therapeutic result"),
    ("Stability and exposure", "Not evaluated", "Protease, serum, solubility, and formulation studies", "Sequence score does not establish usable exposure"),
    ("In-vivo efficacy", "Not evaluated", "Ethically approved disease model", "Requires an independent translational program"),
)
EVIDENCE_COLUMNS = ("endpoint", "status", "required_evidence", "interpretation")

# Objective, outcome, method, diagnostic, robustness.
PLAN = (
    ("Describe biological differences", "Feature distributions", "Effect plots and distribution summaries", "Class balance, outliers, source stratification", "Repeat by source and length band"),
    ("Estimate binary discrimination", "AMP vs putative non-AMP label", "Random Forest and ESM-2 + Logistic Regression", "ROC/PR curves, confusion matrix, calibration", "Similarity-aware versus random split"),
    ("Choose a screening threshold", "Validation MCC", "Threshold search on validation data only", "Sensitivity-specificity trade-off", "Report results across plausible thresholds"),
    ("Assess generalization risk", "Held-out performance", "Group-disjoint test evaluation", "Similarity leakage and subgroup coverage", "External database/release validation"),
)
PLAN_COLUMNS = ("objective", "outcome", "method", "diagnostic", "robustness")

# Question, required label, output, evaluation.
QUESTIONS = (
    ("Does the sequence look AMP-like?", "Curated AMP vs defensible comparator", "Binary score/class", "Discrimination, calibration, leakage control"),
    ("How potent is it against organism X?", "Assay-specific MIC/MBC for organism/strain X", "Potency regression or ordinal class", "Error with assay/source-aware external validation"),
    ("What organisms might it affect?", "Target panel with observed activities/inactivities", "Multilabel spectrum", "Per-target PR metrics and coverage"),
    ("Is it selectively safe?", "Hemolysis/cytotoxicity plus antimicrobial potency", "Safety and selectivity endpoints", "Endpoint-specific error and therapeutic-index uncertainty"),
)
QUESTION_COLUMNS = ("question", "required_label", "output", "evaluation")

# Term and definition.
GLOSSARY = (
    ("AMP-likeness", "Similarity to patterns learned from training labels; not experimental antimicrobial activity."),
    ("Putative non-AMP", "A sequence used as a comparator without experimental proof of inactivity."),
    ("Similarity leakage", "Information transfer when homologous or near-duplicate sequences occur across train and evaluation partitions."),
    ("Calibration", "Agreement between predicted probabilities and observed outcome frequencies in the target population."),
    ("MIC", "Minimum inhibitory concentration under a specified organism, medium, protocol, and endpoint definition."),
    ("Therapeutic index", "A comparison of antimicrobial potency with host-toxicity endpoints; it cannot be inferred from AMP classification alone."),
)

# Name and sequence of the samples.
SAMPLES = (
    ("Custom sequence", "KWKLFKKIGAVLKVL"),
    ("Short cationic example", "KLLKLLKKLLK"),
    ("LL-37 sequence example", "LLGDFFRKSKEKIGKEFKRIVQRIKDFLRNLVPRTES"),
    ("Acidic contrast example", "MDEDDDNQNEEGTQ"),
)

#: Limits of the sequence audit and half the width of the uncertain band.
LOW_ENTROPY, HIGH_HYDROPHOBIC, HIGH_CHARGE_DENSITY, MARGIN = 2.5, 0.65, 0.40, 0.10


def fixed_table(spark: SparkSession, rows: tuple, columns: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame(list(rows), ", ".join(f"{c} string" for c in columns))


def interpretation(score: Column, threshold: float, margin: float = MARGIN) -> Column:
    """Three-way reading of a score; the closed band around the threshold is uncertain."""
    low, high = max(0.0, threshold - margin), min(1.0, threshold + margin)
    return F.when(score.between(low, high), "Uncertain / borderline").when(score > high, "AMP-like").when(score < low, "Non-AMP-like")


def context_rules(rf_model: bool = False) -> Column:
    """Array of descriptive statements on charge, hydropathy, moment and length, from feature columns."""
    charge, gravy, moment, n = F.col("net_charge_pH7"), F.col("gravy"), F.col("hydrophobic_moment"), F.round("length").cast("int")
    # The statements.
    parts = [
        F.when(charge >= 2.0, "The peptide is strongly cationic at pH 7, a common but non-specific AMP characteristic.").when(charge > 0, "The peptide has a mildly positive estimated charge at pH 7.").otherwise("The peptide is neutral or negatively charged at pH 7."),
        F.when(gravy.between(-0.5, 1.2), "Its mean hydropathy is in a mixed polar/hydrophobic range compatible with membrane interaction.").when(gravy > 1.2, "It is highly hydrophobic; this may aid membrane binding but can also raise aggregation or toxicity concerns.").otherwise("It is relatively hydrophilic by the Kyte-Doolittle scale."),
        F.when(moment >= 0.30, "The alpha-helical hydrophobic-moment descriptor suggests amphipathic residue organization.").otherwise("The alpha-helical hydrophobic-moment descriptor is modest; other conformations may still be relevant."),
        F.concat(F.lit("Its length ("), n, F.when(n <= 50, " aa) is within a commonly studied short-peptide range.").otherwise(" aa) is above the common 10–50 aa teaching range.")),
    ]
    if rf_model:
        parts.append(F.lit("These are descriptive feature cues, not local causal explanations of the model score."))
    return F.array(*parts)


def audit_array(length_min: int = 0, length_max: int = 10**9) -> Column:
    """A sequence's five audit rows as an array of (check, status, evidence, implication), from feature columns."""
    n, entropy, hydro, density = F.round("length").cast("int"), F.col("shannon_entropy"), F.col("fraction_hydrophobic"), F.col("charge_density")

    def row(check: str, flag: Column, yes: str, no: str, evidence: Column, why: str, why_not: str) -> Column:
        return F.struct(F.lit(check).alias("check"), F.when(flag, yes).otherwise(no).alias("status"), evidence.alias("evidence"), F.when(flag, why).otherwise(why_not).alias("implication"))

    # Checks, statuses and implications.
    return F.array(
        row("Length domain", n.between(length_min, length_max), "Within model range", "Outside model range", F.format_string(f"%d aa; model range {length_min}–{length_max} aa", n), "No length extrapolation flag", "Treat score as out-of-domain and do not rank with in-domain peptides"),
        row("Sequence complexity", entropy < LOW_ENTROPY, "Low-complexity flag", "No strong flag", F.format_string("Shannon entropy %.2f bits", entropy), "Composition-driven predictions may be unstable", "Residue diversity is not unusually low by this teaching rule"),
        row("Hydrophobic burden", hydro > HIGH_HYDROPHOBIC, "High-hydrophobicity flag", "No strong flag", F.format_string("Hydrophobic residue fraction %.2f", hydro), "Aggregation, solubility, and host-cell toxicity require attention", "No extreme composition flag; experimental safety remains unknown"),
        row("Charge density", F.abs(density) > HIGH_CHARGE_DENSITY, "Extreme-charge flag", "No strong flag", F.format_string("Charge per residue %.3f", density), "May be outside common training behavior; inspect nearest sequences", "Charge is not extreme by this teaching rule"),
        row("Chemical representation", F.lit(True), "Sequence-only limitation", "", F.lit("Canonical L-amino-acid one-letter sequence"), "Termini, D-residues, cyclization, disulfide connectivity, and other modifications are absent", ""),
    )


def sequence_audit(df: DataFrame, length_min: int = 0, length_max: int = 10**9) -> DataFrame:
    """Five audit rows per sequence: (key columns, check, status, evidence, implication), from feature columns."""
    return df.select("sequence", F.explode(audit_array(length_min, length_max)).alias("a")).select("sequence", "a.*")


def dataset_audit(df: DataFrame) -> DataFrame:
    """Six rows (domain, status, evidence) on a table with sequence and label. Null sequences aren't canonical."""
    from .relational import require_columns

    require_columns(df, ("sequence", "label"))
    own = df.withColumn("__s", F.regexp_replace(F.upper("sequence"), r"(?U)\s+|-", ""))
    each = own.groupBy("__s").agg(F.count(F.lit(1)).alias("k"), F.count_distinct("label").alias("labels"), F.sum(F.col("label").try_cast("double")).alias("pos"), F.count(F.col("label").try_cast("double")).alias("labelled"))
    total = each.agg(
        F.sum("k").alias("rows"),
        F.sum(F.when(is_canonical(F.col("__s")), F.col("k")).otherwise(0)).alias("canonical"),
        F.sum(F.col("k") - 1).alias("duplicates"),
        F.count_if(F.col("labels") > 1).alias("conflicts"),
        (F.sum("pos") / F.sum("labelled")).alias("rate"),
    )
    has_splits = {"split", "split_group"} <= set(df.columns)
    if has_splits:
        leaks = df.groupBy("split_group").agg(F.count_distinct("split").alias("s")).agg(F.count_if(F.col("s") > 1)).scalar()
        total = total.withColumn("leaks", leaks)
        split = (F.when(F.col("leaks") == 0, "Pass").otherwise("Critical issue"), F.concat(F.col("leaks"), F.lit(" group(s) occur in more than one split")))
    else:
        split = (F.lit("Not assessable"), F.lit("split and/or split_group column unavailable"))
    sourced = {"source", "source_id", "parent_id"} <= set(df.columns)

    def row(domain: str, status: Column, evidence: Column) -> Column:
        return F.struct(F.lit(domain).alias("domain"), status.alias("status"), evidence.alias("evidence"))

    def passed(ok: Column, otherwise: str) -> Column:
        return F.when(ok, "Pass").otherwise(otherwise)

    # Domains, statuses and evidence texts.
    rows = F.array(
        row("Canonical sequences", passed(F.col("canonical") == F.col("rows"), "Critical issue"), F.concat("canonical", F.lit("/"), "rows", F.lit(" rows use only 20 canonical residues"))),
        row("Exact duplicates", passed(F.col("duplicates") == 0, "Needs revision"), F.concat("duplicates", F.lit(" repeated sequence row(s)"))),
        row("Cross-label conflicts", passed(F.col("conflicts") == 0, "Critical issue"), F.concat("conflicts", F.lit(" sequence(s) carry both labels"))),
        row("Class balance", passed(F.col("rate").between(0.25, 0.75), "Needs revision"), F.concat(F.lit("Positive-class prevalence "), F.format_string("%.1f%%", F.col("rate") * 100))),
        row("Group-disjoint split", *split),
        row("Record provenance", passed(F.lit(sourced), "Needs revision"), F.lit("source, source_id, and parent_id columns present" if sourced else "one or more provenance columns missing")),
    )
    return total.select(F.explode(rows).alias("a")).select("a.*")


def dome_readiness(spark: SparkSession, scientific: bool, status: str = "unknown", has_metrics: bool = False, leakage: bool | None = None) -> DataFrame:
    """Four rows (dome_domain, readiness, present, remaining_risk)."""
    ready = has_metrics and leakage is False and scientific
    # Domains, readiness and risks.
    rows = (
        ("Data", "Ready" if scientific else "Blocked for claims", "Provenance-aware APD/UniProt pipeline", "Verify releases, exclusions, duplicates, and assay heterogeneity" if scientific else "Bundled data are synthetic and cannot support biological findings"),
        ("Optimization", "Ready", "Validation-only threshold selection", "Document every tuned hyperparameter and search range"),
        ("Model", "Ready" if status != "unknown" else "Needs revision", "Versioned feature model and optional frozen ESM-2 encoder", "Probability calibration and subgroup behavior need explicit review"),
        ("Evaluation", "Ready for internal evaluation" if ready else "Needs scientific run", "Held-out metrics, MCC threshold, split diagnostics", "External-release, target-specific, potency, and safety validation are absent"),
    )
    return fixed_table(spark, rows, ("dome_domain", "readiness", "present", "remaining_risk"))


def suppressed_metrics(metrics: DataFrame, status: str) -> DataFrame:
    """The metrics, nulled where the model was fitted on synthetic data."""
    if "synthetic" not in status:
        return metrics
    return metrics.select(*(F.lit(None).cast(t).alias(c) for c, t in metrics.dtypes))


def screening_record(scored: DataFrame, audit: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """(sequence, record): a JSON text per sequence with its score, features, audit rows and unmeasured endpoints."""
    checks = audit.groupBy("sequence").agg(F.array_sort(F.collect_list(F.struct("check", "status", "evidence", "implication"))).alias("audit"))
    unmeasured = F.array(*(F.lit(e[0]) for e in EVIDENCE if e[1] == "Not evaluated"))
    made = F.map_from_arrays(F.array(*(F.lit(f) for f in features)), F.array(*(F.round(F.col(f), 6) for f in features)))
    body = F.struct("sequence", "score", "threshold", "interpretation", made.alias("features"), "audit", unmeasured.alias("unmeasured_endpoints"), F.lit("Resemblance to known sequences only; no evidence of activity.").alias("caveat"))
    return scored.join(checks, "sequence").select("sequence", F.to_json(body).alias("record"))


def batch_screening(raw: DataFrame, score: Column, threshold: float, sequence: str = "sequence") -> DataFrame:
    """All rows kept: normalized_sequence, score, interpretation where valid; ``Invalid`` and validation_error else.

    ``score`` is an expression over ``normalized_sequence``.
    """
    from ..functions.sequence import normalize_sequence

    v = raw.withColumn("__n", normalize_sequence(F.col(sequence)))
    v = v.withColumns({"normalized_sequence": F.col("__n.sequence"), "validation_error": F.col("__n.error")}).drop("__n")
    v = v.withColumn("score", F.when(F.col("normalized_sequence").isNotNull(), score))
    return v.withColumn("interpretation", F.when(F.col("validation_error").isNotNull(), "Invalid").otherwise(interpretation(F.col("score"), threshold)))
