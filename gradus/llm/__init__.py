"""Operators for training text. Nothing outside this subpackage imports it."""
