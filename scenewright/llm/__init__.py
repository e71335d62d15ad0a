"""Operators on training text and match graphs; nothing outside this folder imports them."""
