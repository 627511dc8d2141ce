"""Operators of the label-compliance engine."""
