"""Operators for preparing large text corpora for training.

Each module holds one operator with its own interface; ``queries`` holds the thin registered queries over the driver's
tables. Nothing else in the library imports this subpackage.
"""
