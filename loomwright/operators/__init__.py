"""Base table, temporal windows and propagation along foreign keys."""
