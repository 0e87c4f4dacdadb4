"""Unbounded inputs: none of the statistics here needs them; models.kalman works per series in batches."""
