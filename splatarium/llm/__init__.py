"""Operators for preparing language-model training data on Spark.

Every module holds one operator with a general interface, and a thin query
over the test tables. Nothing outside this package imports it.
"""
