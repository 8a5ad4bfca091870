"""Relational operators: chunking, diff, merges, embedding reuse, top-k, snapshot changes."""
