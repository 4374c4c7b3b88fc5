"""Operators on text and code for training data. Nothing outside this folder imports it."""
