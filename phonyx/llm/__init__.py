"""Operators for preparing language-model training data.

Each module holds one operator with its own general interface; ``queries``
derives the thin ``opN_*`` queries from them.
"""
