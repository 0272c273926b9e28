"""runlens: a PySpark-native engine for log-to-runbook triage analytics."""
