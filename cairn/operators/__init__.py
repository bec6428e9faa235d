"""Relational operators: chunking, dedup, packs, index, snapshots, verify, restore."""
