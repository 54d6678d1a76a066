from .hashing import h32, unit_uniform  # noqa: F401
