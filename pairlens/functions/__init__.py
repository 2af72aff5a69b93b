"""functions of pairlens."""
