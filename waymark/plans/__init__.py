"""plans of the map-matching engine."""
