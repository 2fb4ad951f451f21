"""Operators of a training-data pipeline: one module per operator, bound to the supplied tables in `queries`."""
