"""Operators that make training data of track documents: one module per operator."""
