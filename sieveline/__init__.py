"""Screening, scoring and evaluation of large tabular catalogues on Spark."""
