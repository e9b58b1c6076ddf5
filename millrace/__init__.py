"""Millrace: retrieval analytics on Spark DataFrames.

Vector and lexical search, rank fusion, graph lookups, incremental indexing and evaluation, each an
expression or plan over DataFrames that Catalyst optimises.
"""
