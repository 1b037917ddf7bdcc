"""Readers of raw corpora and parquet sinks."""
