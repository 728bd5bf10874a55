"""Tabiya: document collections, change logs and search as plain Spark DataFrames."""
