"""DataFrame operators.

Every table carries ``ord``, its arrival order; "first", "last" and ties are decided by it.
"""
