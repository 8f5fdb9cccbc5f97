"""Operators of a training-data pipeline. Nothing outside this package, but for the entry file, refers to it."""
