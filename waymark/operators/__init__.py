"""operators of the map-matching engine."""
