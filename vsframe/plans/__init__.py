"""Compositions of the operators: the reference's four questions (``football``)
and the driver queries over the supplied tables (``supplied``)."""
