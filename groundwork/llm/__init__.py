"""Operators for preparing language-model training data on Spark.

Nothing outside this subpackage imports it; ``queries.py`` holds the queries
that apply each operator to its whole table.
"""
