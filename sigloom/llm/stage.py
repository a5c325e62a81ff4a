"""Staged tables, as the rest of the library makes them."""

from sigloom.plans.stage import fresh_path, release, shared_dir, staged

__all__ = ["fresh_path", "release", "shared_dir", "staged"]
