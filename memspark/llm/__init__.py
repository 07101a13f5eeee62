"""Operators of a training-data pipeline: ten corpus operators and their registered queries."""
