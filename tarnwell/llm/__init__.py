"""Corpus-preparation operators for language-model training data.

Nothing else in the library imports this subpackage.  Each module holds one operator with its own general
interface; ``queries`` holds the thin registered queries.
"""
