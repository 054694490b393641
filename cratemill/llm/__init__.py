"""Operators for preparing text corpora; nothing outside this subpackage uses it."""
