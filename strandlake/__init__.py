"""Molecular interaction graph analytics and text-corpus operators on PySpark DataFrames."""
