"""Registered queries; importing the package registers all of them."""

from . import ingest, market, news, streams  # noqa: F401
from .registry import REGISTRY

__all__ = ["REGISTRY"]
