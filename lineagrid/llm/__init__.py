"""Operators for preparing language-model training data, expressed on Spark DataFrames.

Nothing else in the package imports this subpackage; ``queries.py`` holds the
thin contract queries and ``__spark_entry__.py`` adds them when it can be
imported.
"""
