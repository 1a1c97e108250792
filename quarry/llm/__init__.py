"""Operators of a training-data pipeline: deduplication, quality, licences, packing,
mixing, toxicity, chat formatting, HTML extraction and personal data.

Nothing else in the library imports this package. Every operator takes DataFrames and
returns DataFrames; the thin registered queries are in ``jobs``.
"""
