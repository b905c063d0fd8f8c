"""Operators for building a training corpus, and the queries that apply them."""
