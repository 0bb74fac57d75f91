"""Package of the engine's plans."""
