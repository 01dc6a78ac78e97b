"""Correlation rules: incidents that follow from events of several kinds near each other in place and time."""
