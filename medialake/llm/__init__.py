"""Operators of a training-data pipeline over text and vector tables; ``queries`` registers them."""
