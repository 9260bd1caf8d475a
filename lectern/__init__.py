"""Lectern: DataFrame analytics over spoken-content archives, with a training-data toolkit."""
