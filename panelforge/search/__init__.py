"""Search over formulas: deduplication, scoring, guidance, generation, sessions."""
