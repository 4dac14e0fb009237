"""Bibliographic records and documents as Spark DataFrames."""
