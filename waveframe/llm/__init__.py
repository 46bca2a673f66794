"""Operators for preparing text, page and vector corpora for training."""
