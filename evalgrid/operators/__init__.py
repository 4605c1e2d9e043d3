"""Sampling, scoring, validation and ranking over DataFrames."""
