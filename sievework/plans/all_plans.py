"""Importing this module fills the registry."""

from . import (  # noqa: F401
    cascades,
    catalogue,
    concepts,
    consensus,
    interactions,
    intents,
    lookup,
    routing,
    search,
    sources,
    texts,
    vectors,
)
