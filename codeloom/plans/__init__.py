"""The registry of named queries and the SQL that states the same result."""
