"""Sparkweave: multi-model analytics expressed as Spark DataFrame operators."""
