"""Training-data operators: each module is one operator, ``queries`` binds them to the tables."""
