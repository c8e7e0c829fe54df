"""Operators of a training-data pipeline: tokenising, scoring, filtering, deduplication, archives.

Every operator is a function from DataFrame to DataFrame and never changes the rows of its input
unless it says so. Nothing outside this folder imports it.
"""
