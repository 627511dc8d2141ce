"""Sources of the label-compliance engine."""
