"""Training-data operators: one module each, with the queries and SQL that register them."""
