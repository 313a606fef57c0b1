"""Operators for preparing large collections of score documents as training data."""
