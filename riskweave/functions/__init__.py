"""Column builders: plain expressions, no shuffles."""
