"""Operators for large text and vector collections. Nothing outside this
subpackage imports it."""
