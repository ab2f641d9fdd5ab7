"""User-level operators. Each takes a DataFrame of requests."""
