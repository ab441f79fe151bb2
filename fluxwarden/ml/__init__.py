"""Flow analytics: ml."""
