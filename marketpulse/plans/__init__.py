"""Reports and the registered queries."""
