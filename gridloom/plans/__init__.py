"""Designs of experiments as DataFrames, and what runs them."""
