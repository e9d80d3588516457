"""Terms, typed columns, scalar functions and aggregates."""
