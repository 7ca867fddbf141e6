"""Layer builds (Silver, Gold) and the end-to-end run."""
