"""Embedding-space analytics on Spark DataFrames.

``sources``    readers, writers and the shared scratch area
``functions``  column expressions (text, vectors, scores)
``operators``  DataFrame -> DataFrame operators
``plans``      the end-to-end jobs built from the operators
``bindings``   the registered queries over the standard test tables
"""
