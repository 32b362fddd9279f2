"""Operators over quads, states and changes."""
