"""Sources: the driver tables, inputs derived from them, and file sources."""
