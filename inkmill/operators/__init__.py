"""See the package README."""

from . import sections  # registers the default strategy

__all__ = ["sections"]
