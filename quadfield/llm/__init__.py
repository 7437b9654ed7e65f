"""Operators for training-data pipelines.  Each module is one method; ``queries`` registers them."""
