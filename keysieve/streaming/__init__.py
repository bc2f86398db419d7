"""Incremental runs of the same chains."""
