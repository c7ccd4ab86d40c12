"""Text to commands."""

from .commands import parse

__all__ = ["parse"]
