"""Whole jobs: layers from landed feeds, and the registered queries."""
