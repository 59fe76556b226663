"""Operators for training-data preparation; nothing else in docsect imports this subpackage."""
