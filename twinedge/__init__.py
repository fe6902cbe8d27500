"""Judging candidate "same entity" links with Spark DataFrames."""
