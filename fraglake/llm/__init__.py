"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; :mod:`fraglake.llm.queries` applies them to
the standard tables.
"""
