"""Operators on DataFrames: predicates, chunking, deduplication, statistics, change feed, graphs."""
