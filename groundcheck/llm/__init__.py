"""Operators for cleaning, scoring, linking, tokenising and packing training text.

Nothing outside this folder imports it; ``queries.py`` registers one query per operator.
"""
