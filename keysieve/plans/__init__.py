"""Operator chains that answer a whole question."""
