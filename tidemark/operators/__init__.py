"""Relational operators over DataFrames: one Catalyst plan each, nothing collected."""
