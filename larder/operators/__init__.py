"""Operators: DataFrame in, DataFrame out, with columns and thresholds as parameters and no actions inside."""
