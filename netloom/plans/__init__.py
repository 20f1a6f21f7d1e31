"""Loop control, and the registered queries with their SQL."""
