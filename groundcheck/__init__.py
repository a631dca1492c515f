"""Grounding analytics of (context, prompt, response) tables on Spark."""
