"""Operators and the pipeline for training text. Nothing outside this subpackage imports it."""
