"""Operators for preparing training data. Nothing else in quirespark imports this subpackage."""
