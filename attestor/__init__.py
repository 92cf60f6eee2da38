"""Attestor: claim verification and text-corpus analytics as Spark DataFrame plans."""
