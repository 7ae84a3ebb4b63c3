"""Operators of a training-data pipeline over document collections. Nothing else in the library imports this package."""
