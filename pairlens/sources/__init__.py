"""sources of pairlens."""
