"""Quarry: tables, statistics, feature rules and models on Spark DataFrames."""
