"""Sources of the triage engine."""
