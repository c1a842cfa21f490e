"""Functions of the journal engine."""
