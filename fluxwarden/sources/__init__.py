"""Flow analytics: sources."""
