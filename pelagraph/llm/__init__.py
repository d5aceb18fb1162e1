"""Training-data operators: one module each, all reached through :mod:`pelagraph.llm.registry`.

Nothing outside this subpackage imports it.
"""
