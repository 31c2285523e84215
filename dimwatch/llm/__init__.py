"""Operators for building training data from text at scale; nothing outside this subpackage imports it."""
