"""Stores of datasets: file access, catalog with atomic commits, readers of parts and of JSON state."""
