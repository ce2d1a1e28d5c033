"""Training-data operators: each module holds one operator and, with it, the query that applies it."""
