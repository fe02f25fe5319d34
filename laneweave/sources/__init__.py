"""Readers and writers: BAM, BGZF, indexes, annotations."""
