"""End-to-end compositions of the operators (one lazy plan each)."""

from wattle.plans import features  # noqa: F401
