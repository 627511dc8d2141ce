"""Plans of the label-compliance engine."""
