"""Provenance and knowledge analytics on Spark."""
