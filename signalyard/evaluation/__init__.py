"""evaluation of the engine."""
