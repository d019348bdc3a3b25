"""Operators of a training-data pipeline over documents; the rest of the library doesn't import them."""
