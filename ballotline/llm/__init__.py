"""Operators for preparing large training corpora (see the table in README.md).

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
