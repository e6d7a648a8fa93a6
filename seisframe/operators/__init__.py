"""Operators: DataFrame in, DataFrame out, nothing computed until asked."""
