"""Paired-condition text evaluation on Spark."""
