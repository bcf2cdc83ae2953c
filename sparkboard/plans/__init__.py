"""The registered queries: each operator on the given tables, with the SQL which checks it."""
