"""Streaming of the label-compliance engine."""
