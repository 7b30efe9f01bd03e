"""Landed feeds in, layer tables out."""
