"""Quillon: statistics and data-preparation operators expressed over Spark DataFrames."""
