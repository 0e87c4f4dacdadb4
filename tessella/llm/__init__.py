"""Operators for preparing large text corpora for model training.

Nothing outside this package imports it; ``queries`` holds what the driver entry registers.
"""
