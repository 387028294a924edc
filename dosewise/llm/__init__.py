"""Operators of a training-corpus pipeline; one module each, queries in `queries`."""
