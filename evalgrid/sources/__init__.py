"""Corpora and creatures: sources and sinks."""
