"""Resolved statements as DataFrame plans."""
