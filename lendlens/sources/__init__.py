"""Table sources and sinks, the layer catalogue, and the star-schema binding."""
