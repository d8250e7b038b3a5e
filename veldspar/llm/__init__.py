"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Each operator module keeps a general interface;
``queries`` holds the thin ``opN_*`` queries and their SQL.
"""
