"""Operators for building language-model training data.

Nothing else in the library imports this subpackage.  Each module holds
one operator; ``queries`` registers one query per operator and
``corpus_pipeline.py`` at the repository top chains five of them.
"""
