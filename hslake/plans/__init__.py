"""Plans of the journal engine."""
