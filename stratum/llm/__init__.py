"""Operators for building a language-model training corpus.

Every module here is self-contained on top of PySpark and the small helpers in
``stratum.session``; nothing else in the library imports this package.
"""
