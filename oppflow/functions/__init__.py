"""Part of oppflow."""
