"""Functions of the triage engine."""
