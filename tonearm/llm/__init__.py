"""Operators of a training-data pipeline: archives, filters, duplicates, models and mixing."""
