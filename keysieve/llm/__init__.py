"""Operators for preparing training text, each on its own; nothing else imports them."""
