"""Operators of a training-data pipeline: filters, duplicate removal, counts and mixing."""
