"""Catalogue building and entity resolution on Spark DataFrames."""
