"""Joins, aggregations and estimators: DataFrame in, DataFrame out."""
