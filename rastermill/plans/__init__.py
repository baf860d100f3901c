"""The tables, queries and SQL that the registry offers."""
