"""DataFrame to DataFrame operators (ranking, mixing, grouping, expansion, reporting)."""
