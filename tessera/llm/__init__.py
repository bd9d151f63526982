"""Operators of a training-data pipeline: deduplication, mixing, toxicity,
quality, tokenisation, URL rules, language-model scores, vector search and
personal data. Nothing outside this folder (and ``corpus_pipeline.py``)
imports it."""
