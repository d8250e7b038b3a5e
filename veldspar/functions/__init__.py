"""Builtin and custom functions of expressions."""
