"""Operators on text and code corpora for training data. Nothing outside this subpackage imports it."""
