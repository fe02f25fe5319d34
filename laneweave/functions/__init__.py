"""Column functions: intervals, CIGAR geometry, tags, hashing, keys."""
