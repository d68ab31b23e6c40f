"""Operators that prepare text and records for training corpora. Nothing outside this subpackage imports it."""
