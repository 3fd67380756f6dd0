"""Rillscan: review of source-code corpora and their finding history as Spark jobs."""
