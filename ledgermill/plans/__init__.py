"""Session settings, derived tables and the registered queries."""
