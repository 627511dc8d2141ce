"""Functions of the label-compliance engine."""
