"""Operators for preparing training data (texts, pages and vectors) at corpus scale.

Nothing else in the library imports this subpackage.
"""
