"""sources of the map-matching engine."""
