"""Operators of a training-data pipeline (see README, section LLM operators).

Nothing else in the library imports this subpackage.
"""
