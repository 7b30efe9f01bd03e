"""Spark jobs over geographic feature tables: feeds in, classified and matched features out."""
