"""Package of the engine's operators."""
