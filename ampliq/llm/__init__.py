"""Operators of a training-data pipeline: near duplicates, archives, shards, fingerprints, secrets, tokens, text and quality.

Nothing else in the library imports this package. ``queries`` holds the registered queries and their SQL.
"""
