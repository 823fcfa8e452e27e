"""Operators for preparing language-model training corpora.

Nothing else in ``pairweave`` imports this subpackage.
"""
