"""Study specifications, the scan over them, and the registered queries."""
