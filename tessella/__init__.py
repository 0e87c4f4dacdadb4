"""Spatial statistics over labelled point tables as Spark plans."""
