"""streaming of the map-matching engine."""
