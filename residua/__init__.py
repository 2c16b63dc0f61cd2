"""Peptide screening and data auditing as Spark DataFrame operators."""

__version__ = "0.1.0"
