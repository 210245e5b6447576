"""Counts that grow as read files arrive."""
