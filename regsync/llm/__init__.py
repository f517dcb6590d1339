"""Operators for preparing training text.  Nothing else in ``regsync`` imports this subpackage."""
