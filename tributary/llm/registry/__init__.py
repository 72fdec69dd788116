"""One module per query: its name, the query, and its SQL where there is some."""
