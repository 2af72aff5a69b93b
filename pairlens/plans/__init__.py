"""plans of pairlens."""
