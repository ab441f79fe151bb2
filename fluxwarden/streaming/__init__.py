"""Flow analytics: streaming."""
