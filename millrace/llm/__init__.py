"""Operators for preparing language-model training data, one module for each.

Nothing else in the package imports this subpackage.
"""
