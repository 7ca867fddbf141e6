"""Column expressions: text standardisers, pricing economics, label and bin rules."""
