"""Operators that prepare free text of the map (notes, strings, pages) as training data."""
