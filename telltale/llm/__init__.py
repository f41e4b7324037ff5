"""Operators of a training-data pipeline over text, page and vector tables. Nothing else in the library imports them."""
