"""Query plans: the registered queries and the end-to-end workflow flows."""
