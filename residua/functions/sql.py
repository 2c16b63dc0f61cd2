"""The sequence functions for SQL: temporary functions of the session, expressions all of them, so nothing leaves the JVM.

``register(spark)`` makes them known; ``SELECT screen_gravy(sequence) FROM t`` and
``SELECT a.* FROM t, LATERAL screen_audit(sequence, 10, 42) a`` then work in any query of the session.
"""

from __future__ import annotations

import math
from string import ascii_uppercase

from pyspark.sql import SparkSession

from . import constants as K

#: Limits of the audit's flags.
LOW_ENTROPY, HIGH_HYDROPHOBIC, HIGH_CHARGE_DENSITY = 2.5, 0.65, 0.4
#: Longest sequence whose terms of the entropy are tabled.
TABLED = 64


def _map(table: dict) -> str:
    return "map(" + ", ".join(f"'{k}', {float(v)!r}D" for k, v in table.items()) + ")"


def _weighted(table: dict) -> str:
    return " + ".join(f"screen_one(s, '{a}') * {float(w)!r}D" for a, w in table.items())


def _charge() -> str:
    """Henderson-Hasselbalch terms of the residues and of both ends."""
    first = f"coalesce(try_element_at({_map(K.PK_N_TERMINUS_OF)}, substr(s, 1, 1)), {K.PK_N_TERMINUS!r}D)"
    last = f"coalesce(try_element_at({_map(K.PK_C_TERMINUS_OF)}, right(s, 1)), {K.PK_C_TERMINUS!r}D)"
    plus = [f"screen_one(s, '{a}') / (1 + pow(10D, ph - {v!r}D))" for a, v in K.PK_POSITIVE.items()] + [f"1 / (1 + pow(10D, ph - {first}))"]
    minus = [f"screen_one(s, '{a}') / (1 + pow(10D, {v!r}D - ph))" for a, v in K.PK_NEGATIVE.items()] + [f"1 / (1 + pow(10D, {last} - ph))"]
    return f"({' + '.join(plus)}) - ({' + '.join(minus)})"


def _letter(place: str) -> str:
    """The number of the letter at a place, from 0 for A; an array by letters is read at once, a map is searched."""
    return f"ascii(substr(s, {place}, 1)) - 65"


def _turned(turn: str) -> str:
    """The sum of hydrophobicities, each times sine or cosine of its turn."""
    weights = ", ".join(f"{float(K.EISENBERG[a])!r}D" if a in K.EISENBERG else "CAST(NULL AS DOUBLE)" for a in ascii_uppercase)
    return f"aggregate(sequence(0, length(s) - 1), 0D, (a, i) -> a + get(array({weights}), {_letter('i + 1')}) * {turn}(i * {math.radians(100)!r}D))"


def _entropy_terms() -> list[float]:
    """Share times its binary logarithm, of k residues in n at place n (n + 1) / 2 + k, for n up to TABLED.

    Spark's log2 divides two natural logarithms and is off in the last place, which decides entropies that are equal to a limit.
    """
    return [k / n * math.log2(k / n) if k else 0.0 for n in range(TABLED + 1) for k in range(n + 1)]


def functions() -> dict[str, tuple[str, str, str]]:
    """Name to (parameters, what it returns, body). A null sequence gives null, and an audit of nulls."""
    pairs = ", ".join("CAST(split('" + ",".join(repr(float(K.INSTABILITY.get(a, {}).get(b, 1.0))) for b in ascii_uppercase) + "', ',') AS ARRAY<DOUBLE>)" for a in ascii_uppercase)
    # Counts appear outside of conditions only, so that expressions which share them count once. Longer sequences have no terms in the table;
    # theirs are folded, which takes less code than twenty conditions.
    terms = "CAST(split('" + ",".join(map(repr, _entropy_terms())) + "', ',') AS ARRAY<DOUBLE>)"
    tabled = " + ".join(f"get({terms}, length(s) * (length(s) + 1) div 2 + screen_one(s, '{a}'))" for a in K.RESIDUES)
    folded = f"aggregate(array({', '.join(f"screen_one(s, '{a}')" for a in K.RESIDUES)}), 0D, (a, k) -> a + if(k > 0, k / length(s) * log2(k / length(s)), k * 0D))"
    hydrophobic = next(g for n, g in K.CLASSES.items() if n == "fraction_hydrophobic")
    flags = (  # Fixed values: checks and their statuses.
        ("Length domain", "n BETWEEN low AND high", "Within model range", "Outside model range"),
        ("Sequence complexity", f"entropy < {LOW_ENTROPY}D", "Low-complexity flag", "No strong flag"),
        ("Hydrophobic burden", f"share > {HIGH_HYDROPHOBIC}D", "High-hydrophobicity flag", "No strong flag"),
        ("Charge density", f"density > {HIGH_CHARGE_DENSITY}D", "Extreme-charge flag", "No strong flag"),
    )
    rows = ", ".join(f"struct('{c}' AS check, CASE WHEN {f} THEN '{yes}' WHEN NOT ({f}) THEN '{no}' END AS status)" for c, f, yes, no in flags)
    return {
        "screen_parent": ("raw STRING", "STRING", f"if(raw IS NULL, NULL, if(upper(regexp_replace(raw, '(?U)[\\\\s-]+', '')) RLIKE '^[{K.RESIDUES}]+$', upper(regexp_replace(raw, '(?U)[\\\\s-]+', '')), ''))"),
        "screen_sha256": ("s STRING", "STRING", "sha2(s, 256)"),
        "screen_count": ("s STRING, residues STRING", "INT", "length(s) - length(translate(s, residues, ''))"),
        "screen_one": ("s STRING, residue STRING", "INT", "length(s) - length(replace(s, residue, ''))"),
        "screen_share": ("s STRING, residues STRING", "DOUBLE", "screen_count(s, residues) / length(s)"),
        "screen_gravy": ("s STRING", "DOUBLE", f"({_weighted(K.KYTE_DOOLITTLE)}) / length(s)"),
        "screen_weight": ("s STRING", "DOUBLE", f"{_weighted(K.MASSES)} - (length(s) - 1) * {K.WATER!r}D"),
        "screen_charge": ("s STRING, ph DOUBLE", "DOUBLE", _charge()),
        "screen_entropy": ("s STRING", "DOUBLE", f"-coalesce({tabled}, {folded})"),
        "screen_moment": ("s STRING", "DOUBLE", f"sqrt(pow({_turned('cos')}, 2) + pow({_turned('sin')}, 2)) / length(s)"),
        "screen_instability": ("s STRING", "DOUBLE", f"10D / length(s) * if(length(s) > 1, aggregate(sequence(1, length(s) - 1), 0D, (a, i) -> a + coalesce(get(get(array({pairs}), {_letter('i')}), {_letter('i + 1')}), 1D)), 0D)"),
        "screen_flags": ("n INT, entropy DOUBLE, share DOUBLE, density DOUBLE, low INT, high INT", "ARRAY<STRUCT<check: STRING, status: STRING>>", f"array({rows})"),
        # For whole tables, select screen_checks(s, low, high) and explode that: a lateral table function becomes a join of the table with itself.
        "screen_checks": ("s STRING, low INT, high INT", "ARRAY<STRUCT<check: STRING, status: STRING>>", f"screen_flags(length(s), screen_entropy(s), screen_share(s, '{hydrophobic}'), abs(screen_charge(s, 7D) / length(s)), low, high)"),
        "screen_audit": ("s STRING, low INT, high INT", "TABLE (check STRING, status STRING)", "SELECT r.check, r.status FROM (SELECT screen_checks(s, low, high) AS flags) LATERAL VIEW explode(flags) e AS r"),
    }


def register(spark: SparkSession) -> None:
    """Creates or replaces the functions in the session; later ones use earlier ones."""
    for name, (parameters, returns, body) in functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
