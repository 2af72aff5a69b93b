"""operators of pairlens."""
