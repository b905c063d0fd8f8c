"""Curation, evaluation and comparison operators: DataFrame in, DataFrame out."""
