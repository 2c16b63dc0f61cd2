"""Fixed values of peptide chemistry and of the screening rules."""

from __future__ import annotations

# The 20 canonical residues, in order.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"

# Eisenberg consensus hydrophobicity, used for the helical moment.
EISENBERG = {"A": 0.25, "R": -1.76, "N": -0.64, "D": -0.72, "C": 0.04, "Q": -0.69, "E": -0.62, "G": 0.16, "H": -0.40, "I": 0.73, "L": 0.53, "K": -1.10, "M": 0.26, "F": 0.61, "P": -0.07, "S": -0.26, "T": -0.18, "W": 0.37, "Y": 0.02, "V": 0.54}

# Kyte-Doolittle hydropathy (1982).
KYTE_DOOLITTLE = {"A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2}

# Average masses of free amino acids and of water, in Da.
MASSES = {"A": 89.0932, "C": 121.1582, "D": 133.1027, "E": 147.1293, "F": 165.1891, "G": 75.0666, "H": 155.1546, "I": 131.1729, "K": 146.1876, "L": 131.1729, "M": 149.2113, "N": 132.1179, "P": 115.1305, "Q": 146.1445, "R": 174.2010, "S": 105.0926, "T": 119.1192, "V": 117.1463, "W": 204.2252, "Y": 181.1885}
WATER = 18.0153

# The Bjellqvist pK set, side chains and termini.
PK_POSITIVE = {"K": 10.0, "R": 12.0, "H": 5.98}
PK_NEGATIVE = {"D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}
PK_N_TERMINUS, PK_C_TERMINUS = 7.5, 3.55
PK_N_TERMINUS_OF = {"A": 7.59, "M": 7.0, "S": 6.93, "P": 8.36, "T": 6.82, "V": 7.44, "E": 7.7}
PK_C_TERMINUS_OF = {"D": 4.55, "E": 4.75}
# Bisection for the isoelectric point: first guess, interval, width.
PI_FIRST, PI_LOW, PI_HIGH, PI_WIDTH = 7.775, 4.05, 12.0, 1e-4

# Guruprasad (1990) dipeptide weights, by first residue; pairs not listed weigh 1.
INSTABILITY = {
    "A": {"C": 44.94, "D": -7.49, "H": -7.49, "P": 20.26},
    "C": {"D": 20.26, "H": 33.60, "M": 33.60, "L": 20.26, "Q": -6.54, "P": 20.26, "T": 33.60, "W": 24.68, "V": -6.54},
    "D": {"F": -6.54, "K": -7.49, "S": 20.26, "R": -6.54, "T": -14.03},
    "E": {"C": 44.94, "E": 33.60, "D": 20.26, "I": 20.26, "H": -6.54, "Q": 20.26, "P": 20.26, "S": 20.26, "W": -14.03},
    "F": {"D": 13.34, "K": -14.03, "P": 20.26, "Y": 33.60},
    "G": {"A": -7.49, "E": -6.54, "G": 13.34, "I": -7.49, "K": -7.49, "N": -7.49, "T": -7.49, "W": 13.34, "Y": -7.49},
    "H": {"G": -9.37, "F": -9.37, "I": 44.94, "K": 24.68, "N": 24.68, "P": -1.88, "T": -6.54, "W": -1.88, "Y": 44.94},
    "I": {"E": 44.94, "H": 13.34, "K": -7.49, "L": 20.26, "P": -1.88, "V": -7.49},
    "K": {"G": -7.49, "I": -7.49, "M": 33.60, "L": -7.49, "Q": 24.64, "P": -6.54, "R": 33.60, "V": -7.49},
    "L": {"K": -7.49, "Q": 33.60, "P": 20.26, "R": 20.26, "W": 24.68},
    "M": {"A": 13.34, "H": 58.28, "M": -1.88, "Q": -6.54, "P": 44.94, "S": 44.94, "R": -6.54, "T": -1.88, "Y": 24.68},
    "N": {"C": -1.88, "G": -14.03, "F": -14.03, "I": 44.94, "K": 24.68, "Q": -6.54, "P": -1.88, "T": -7.49, "W": -9.37},
    "P": {"A": 20.26, "C": -6.54, "E": 18.38, "D": -6.54, "F": 20.26, "M": -6.54, "Q": 20.26, "P": 20.26, "S": 20.26, "R": -6.54, "W": -1.88, "V": 20.26},
    "Q": {"C": -6.54, "E": 20.26, "D": 20.26, "F": -6.54, "Q": 20.26, "P": 20.26, "S": 44.94, "V": -6.54, "Y": -6.54},
    "R": {"G": -7.49, "H": 20.26, "N": 13.34, "Q": 20.26, "P": 20.26, "S": 44.94, "R": 58.28, "W": 58.28, "Y": -6.54},
    "S": {"C": 33.60, "E": 20.26, "Q": 20.26, "P": 44.94, "S": 20.26, "R": 20.26},
    "T": {"E": 20.26, "G": -7.49, "F": 13.34, "N": -14.03, "Q": -6.54, "W": -14.03},
    "V": {"D": -14.03, "G": -7.49, "K": -1.88, "P": 20.26, "T": -7.49, "Y": -6.54},
    "W": {"A": -14.03, "G": -9.37, "H": 24.68, "M": 24.68, "L": 13.34, "N": 13.34, "T": -14.03, "V": -7.49},
    "Y": {"A": 24.68, "E": -6.54, "D": 24.68, "G": -7.49, "H": 13.34, "M": 44.94, "P": 13.34, "R": -15.91, "T": -7.49, "W": -9.37, "Y": 13.34},
}

# Residue classes of the fraction features.
CLASSES = {"fraction_hydrophobic": "AILMFWVY", "fraction_basic": "KRH", "fraction_acidic": "DE", "fraction_polar": "STNQ"}

# Core features in order, with their display labels.
FEATURE_LABELS = {
    "length": "Length (aa)",
    "net_charge_pH7": "Net charge at pH 7",
    "charge_density": "Charge density",
    "gravy": "Mean hydropathy (GRAVY)",
    "hydrophobic_moment": "Alpha-helical hydrophobic moment",
    "aromaticity": "Aromaticity",
    "isoelectric_point": "Isoelectric point",
    "molecular_weight": "Molecular weight (Da)",
    "instability_index": "Instability index",
    "shannon_entropy": "Sequence entropy",
    "fraction_hydrophobic": "Hydrophobic-residue fraction",
    "fraction_basic": "Basic-residue fraction",
    "fraction_acidic": "Acidic-residue fraction",
    "fraction_polar": "Polar-residue fraction",
}
CORE_FEATURES = tuple(FEATURE_LABELS)
COMPOSITION_FEATURES = tuple(f"aa_{a}" for a in RESIDUES)
FEATURES = CORE_FEATURES + COMPOSITION_FEATURES
