"""Operators of a training-data pipeline: tokens, quality, near duplicates, media, packing, mixing.

Every operator takes a DataFrame and column names, keeps to those columns (others, whatever their
names, are ignored) and returns a DataFrame. Nothing outside this subpackage imports it.
"""
