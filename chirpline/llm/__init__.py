"""Operators for preparing training data: one module for each, and the helpers they share."""
