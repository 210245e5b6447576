"""Column functions: sequences, CIGAR strings, statistics."""
