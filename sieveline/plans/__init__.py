"""Frozen parameters that operators are planned from."""
