"""Operators over clouds (point_id, x, y, z)."""
