"""The exploration statements, phase by phase."""
