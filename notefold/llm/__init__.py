"""Operators for training data from texts and vectors. Nothing else in the library imports them."""
