"""SQL surface and the registered queries."""
