"""Price and weather stand-ins derived from the given tables, with queries and SQL to check them."""
