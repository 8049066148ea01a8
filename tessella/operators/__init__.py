"""Relational operators over DataFrames: thin, declarative, planned by Catalyst."""
