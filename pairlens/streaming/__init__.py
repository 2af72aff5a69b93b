"""streaming of pairlens."""
