"""Operators for large-scale training-data pipelines.

Nothing outside this folder imports it; ``__spark_entry__`` registers its
queries only when it is present.
"""
