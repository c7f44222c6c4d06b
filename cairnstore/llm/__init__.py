"""Operators for preparing training corpora.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; :mod:`cairnstore.llm.catalogue` holds the thin
``opN_<name>`` queries and their oracle SQL.
"""
