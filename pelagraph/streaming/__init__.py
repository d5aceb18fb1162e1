"""Keeping an index up to date while nodes arrive."""
