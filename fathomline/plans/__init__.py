"""Commands to plans."""
