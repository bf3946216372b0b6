"""Operators for the texts and scores of training data. Nothing else in the package imports this."""
