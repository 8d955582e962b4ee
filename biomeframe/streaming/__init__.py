"""Incremental counting of newly arrived samples."""
