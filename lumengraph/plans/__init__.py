"""Entity selections and the registered queries."""
