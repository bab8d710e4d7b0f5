"""Where tables, keys and lists come from."""
