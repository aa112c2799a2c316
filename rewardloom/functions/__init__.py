"""Column builders: pure expressions, no actions, no shuffles."""
