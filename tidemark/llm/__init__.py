"""Operators for preparing text and vectors for model training.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
