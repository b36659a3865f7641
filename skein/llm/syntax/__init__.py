"""Grammars and an error-correcting chart parser for five languages."""
