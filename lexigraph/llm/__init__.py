"""Operators on training text: an optional subpackage that nothing else imports."""
