"""Operators for preparing language-model training data.

Nothing else in the library imports this package; it imports nothing of the
library either, so that either side can be removed on its own.
"""
