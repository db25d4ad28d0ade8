"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it; ``queries`` lists what it offers.
"""
