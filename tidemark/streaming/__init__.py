"""Package of the engine's streaming."""
