"""Chromatin-to-network analytics expressed as Spark DataFrame operators."""
