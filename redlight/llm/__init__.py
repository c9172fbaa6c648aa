"""Operators for preparing language-model training corpora, each a Spark job.

Nothing else in the library imports this subpackage.
"""
