"""Relational operators beside apply."""
