"""Readers and writers: listings, index documents, snapshots."""
