"""Registered queries: each runs one operator or job over the whole of the given tables, with the
SQL that must give the same rows where plain SQL can say it."""
