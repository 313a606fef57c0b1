"""Operators: DataFrame in, DataFrame out, nothing collected to the driver."""
