"""Operators for training data: matching, survivorship, names, packing, leaks and splitting. Nothing outside imports this."""
