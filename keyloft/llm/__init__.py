"""Operators of a training-data pipeline: documents, pages, conversations.

Nothing outside this folder imports it; remove the folder and the rest of the library works as before.
"""
