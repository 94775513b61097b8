"""Operators for preparing language-model training data.

Nothing else in tilewright imports this subpackage, and it can be deleted as a
whole.  ``queries`` holds the driver's ``opN_*`` queries and their SQL.
"""
