"""Tidepipe: lazy, ordered pipelines of stream operators on PySpark DataFrames."""
