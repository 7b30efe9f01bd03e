"""Operators on feature tables, all usable through ``DataFrame.transform``."""
