"""Readers, the derived test views, SQL over views, and table-set jobs (copy, export, restore, profile)."""
