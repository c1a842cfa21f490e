"""Sources of the journal engine."""
