"""The 34 sequence features as column expressions; with_features finds the isoelectric point by batch."""

from __future__ import annotations

import math
from string import ascii_uppercase

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as K


def residue_count(sequence: Column, residue: str) -> Column:
    return F.length(sequence) - F.length(F.replace(sequence, F.lit(residue), F.lit("")))


def _sum(parts) -> Column:
    out = None
    for p in parts:
        out = p if out is None else out + p
    return out


def _lookup(table: dict[str, float], default: float | None, key: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    got = F.try_element_at(pairs, key)
    return got if default is None else F.coalesce(got, F.lit(default))


def _letter(sequence: Column, place: Column) -> Column:
    """The number of the letter at a 1-based place: 0 for A to 25 for Z; anything else lies outside of that."""
    return F.ascii(F.substr(sequence, place, F.lit(1))) - F.lit(ord("A"))


def _terminal_pks(first: Column, last: Column) -> tuple[Column, Column]:
    return _lookup(K.PK_N_TERMINUS_OF, K.PK_N_TERMINUS, first), _lookup(K.PK_C_TERMINUS_OF, K.PK_C_TERMINUS, last)


def _charge(ph: Column, counts: dict[str, Column], n_pk: Column, c_pk: Column) -> Column:
    ten = F.lit(10.0)
    plus = [counts[a] / (1 + F.pow(ten, ph - pk)) for a, pk in K.PK_POSITIVE.items()] + [1 / (1 + F.pow(ten, ph - n_pk))]
    minus = [counts[a] / (1 + F.pow(ten, F.lit(pk) - ph)) for a, pk in K.PK_NEGATIVE.items()] + [1 / (1 + F.pow(ten, c_pk - ph))]
    return _sum(plus) - _sum(minus)


def charge_at(ph: Column, counts: dict[str, Column], first: Column, last: Column) -> Column:
    """Henderson-Hasselbalch charge; first and last residue set the pK of the termini."""
    return _charge(ph, counts, *_terminal_pks(first, last))


def isoelectric_point(counts: dict[str, Column], first: Column, last: Column) -> Column:
    """Bisection on the charge, until the interval is narrow enough."""
    steps = math.ceil(math.log2((K.PI_HIGH - K.PI_LOW) / K.PI_WIDTH)) + 1
    # Counts and pKs are part of the state, so that they are computed once and not in every step.
    held = [*K.PK_POSITIVE, *K.PK_NEGATIVE]

    def charge(s: Column) -> Column:
        return _charge(s["ph"], {a: s[f"n_{a}"] for a in held}, s["pk_n"], s["pk_c"])

    def step(s: Column, _: Column) -> Column:
        def moved(low: Column, high: Column) -> Column:
            return F.struct(low.alias("low"), high.alias("high"), ((low + high) / 2).alias("ph"), *(s[f"n_{a}"].alias(f"n_{a}") for a in held), s["pk_n"].alias("pk_n"), s["pk_c"].alias("pk_c"))

        return F.when(s["high"] - s["low"] <= K.PI_WIDTH, s).when(charge(s) > 0, moved(s["ph"], s["high"])).otherwise(moved(s["low"], s["ph"]))

    n_pk, c_pk = _terminal_pks(first, last)
    start = F.struct(F.lit(K.PI_LOW).alias("low"), F.lit(K.PI_HIGH).alias("high"), F.lit(K.PI_FIRST).alias("ph"), *(counts[a].cast("double").alias(f"n_{a}") for a in held), n_pk.alias("pk_n"), c_pk.alias("pk_c"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["ph"])


def _bisected(*columns: pd.Series) -> pd.Series:
    """isoelectric_point of a batch, from the counts of K.PK_POSITIVE and K.PK_NEGATIVE and the pKs of both ends.

    Only the charge's sign matters, so 10^pH is raised once a step: 1 / (1 + 10^(pH - pK)) is 10^pK / (10^pK + 10^pH).
    """
    *counts, n_end, c_end = (c.to_numpy(np.float64) for c in columns)
    n_end, c_end = 10.0**n_end, 10.0**c_end
    low, high, ph = (np.full(len(n_end), v) for v in (K.PI_LOW, K.PI_HIGH, K.PI_FIRST))
    while (open_ := high - low > K.PI_WIDTH).any():
        x = 10.0**ph
        charge = n_end / (n_end + x) - x / (c_end + x)
        for n, pk in zip(counts, K.PK_POSITIVE.values()):
            charge += n * 10.0**pk / (10.0**pk + x)
        for n, pk in zip(counts[len(K.PK_POSITIVE) :], K.PK_NEGATIVE.values()):
            charge -= n * x / (10.0**pk + x)
        low, high = np.where(open_ & (charge > 0), ph, low), np.where(open_ & ~(charge > 0), ph, high)
        ph = np.where(open_, (low + high) / 2, ph)
    return pd.Series(ph)


def hydrophobic_moment(sequence: Column, degrees: float = 100.0) -> Column:
    """Length of the mean hydrophobicity vector, each residue turned by the helix angle."""
    n = F.length(sequence)
    angle = math.radians(degrees)
    # An array by letter: a map is searched entry by entry.
    weights = F.array(*(F.lit(K.EISENBERG.get(a)).cast("double") for a in ascii_uppercase))

    def part(turn) -> Column:
        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, i: a + F.get(weights, _letter(sequence, i + 1)) * turn(i * angle))

    return F.sqrt(F.pow(part(F.cos), 2) + F.pow(part(F.sin), 2)) / n


def instability_index(sequence: Column) -> Column:
    # Rows by the first letter, in them places by the second; from text, so that the plan holds a row as one value.
    rows = (",".join(repr(float(K.INSTABILITY.get(a, {}).get(b, 1.0))) for b in ascii_uppercase) for a in ascii_uppercase)
    weights = F.array(*(F.split(F.lit(r), ",").cast("array<double>") for r in rows))
    n = F.length(sequence)
    total = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0.0), lambda a, i: a + F.coalesce(F.get(F.get(weights, _letter(sequence, i)), _letter(sequence, i + 1)), F.lit(1.0)))
    return 10.0 / n * F.when(n > 1, total).otherwise(0.0)


def feature_columns(sequence: Column, names: tuple[str, ...] = K.FEATURES, counts: dict[str, Column] | None = None) -> dict[str, Column]:
    """The named features of a canonical sequence; null stays null. counts: the residues' counts, if they are columns already."""
    n = F.length(sequence)
    counts = counts or {a: residue_count(sequence, a) for a in K.RESIDUES}
    first, last = F.substr(sequence, F.lit(1), F.lit(1)), F.substr(sequence, n, F.lit(1))
    charge = charge_at(F.lit(7.0), counts, first, last)
    made = {
        "length": lambda: n.cast("double"),
        "net_charge_pH7": lambda: charge,
        "charge_density": lambda: charge / n,
        "gravy": lambda: _sum(counts[a] * w for a, w in K.KYTE_DOOLITTLE.items()) / n,
        "hydrophobic_moment": lambda: hydrophobic_moment(sequence),
        "aromaticity": lambda: _sum(counts[a] for a in "FWY") / n,
        "isoelectric_point": lambda: isoelectric_point(counts, first, last),
        "molecular_weight": lambda: _sum(counts[a] * w for a, w in K.MASSES.items()) - (n - 1) * K.WATER,
        "instability_index": lambda: instability_index(sequence),
        "shannon_entropy": lambda: -_sum(F.when(c > 0, c / n * F.log2(c / n)).otherwise(0.0) for c in counts.values()),
    }
    made |= {name: (lambda group=group: _sum(counts[a] for a in group) / n) for name, group in K.CLASSES.items()}
    made |= {f"aa_{a}": (lambda a=a: counts[a] / n) for a in K.RESIDUES}
    return {name: made[name]() for name in names}


def with_features(df: DataFrame, sequence: str = "sequence", names: tuple[str, ...] = K.FEATURES) -> DataFrame:
    """df with the named feature columns, in their order; existing ones are replaced.

    Residues are counted in a projection of their own: expressions that share them would count anew in each.
    """
    prefix = "__count_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = f"_{prefix}"
    counted = {a: f"{prefix}{a}" for a in K.RESIDUES}
    rows = df.withColumns({c: residue_count(F.col(sequence), a) for a, c in counted.items()})
    counts, point = {a: F.col(c) for a, c in counted.items()}, "isoelectric_point"
    made = feature_columns(F.col(sequence), tuple(n for n in names if n != point), counts)
    if point in names:
        # By batch: as an expression, the loop is interpreted, and unrolled it is too long a method to be compiled.
        ends = _terminal_pks(F.substr(F.col(sequence), F.lit(1), F.lit(1)), F.substr(F.col(sequence), F.length(sequence), F.lit(1)))
        found = F.pandas_udf(_bisected, "double")(*(counts[a] for a in (*K.PK_POSITIVE, *K.PK_NEGATIVE)), *ends)
        made[point] = F.when(F.col(sequence).isNotNull(), found)
    return rows.withColumns({n: made[n] for n in names}).drop(*counted.values())


def feature_label(name: Column) -> Column:
    """Display label; ``aa_X`` becomes ``X``."""
    return F.coalesce(_lookup(K.FEATURE_LABELS, None, name), F.replace(name, F.lit("aa_"), F.lit("")))


def scaled_position(value: Column, low: Column, high: Column) -> Column:
    """Place between two quantiles, clamped to [0, 1]; 0.5 where they don't differ."""
    return F.when(high <= low, F.lit(0.5)).otherwise(F.least(F.greatest((value - low) / (high - low), F.lit(0.0)), F.lit(1.0)))
