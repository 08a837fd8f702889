"""Operators for training-data pipelines of language models. Nothing outside this package imports it."""
