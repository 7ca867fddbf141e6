"""DataFrame operators: ranks, deduplication, features, quality, models."""
