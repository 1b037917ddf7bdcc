"""Relational operators over unified corpora."""
