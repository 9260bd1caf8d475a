"""Part of the lectern library."""
