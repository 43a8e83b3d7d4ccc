"""Operators for preparing training data; nothing else in the library imports this subpackage."""
