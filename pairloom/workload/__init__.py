"""Registered queries over the derived inputs, and the same results in plain SQL."""
