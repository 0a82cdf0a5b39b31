"""Training-data operators: one module per operator, queries in :mod:`pathweave.llm.queries`.

Nothing outside this subpackage imports it.
"""
