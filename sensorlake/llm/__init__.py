"""Operators on text corpora for training data, their registered queries and SQL."""
