"""Lexers of the five source languages."""
