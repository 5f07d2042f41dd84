"""Input tables and the registry of sources."""
