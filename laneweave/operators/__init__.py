"""DataFrame operators: routing, features, statistics, checks."""
