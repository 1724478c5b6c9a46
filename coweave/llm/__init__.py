"""Operators for training-data pipelines: filtering, deduplication, tokenization and language models.

Self-contained: nothing outside this folder imports it, so it can be removed without touching the rest.
"""
