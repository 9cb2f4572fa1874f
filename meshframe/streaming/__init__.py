"""Incremental runs of the landing job."""
