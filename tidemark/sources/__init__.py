"""Package of the engine's sources."""
