"""Operators for training data made of text. Nothing outside this subpackage imports it."""
