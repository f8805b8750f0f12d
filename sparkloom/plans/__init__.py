"""Plan-level helpers: written intermediate tables and loop control."""
