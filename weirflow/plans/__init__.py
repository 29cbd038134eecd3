"""All queries of the library: importing this package fills the registry."""

from weirflow.plans import drift, history, lineage, parsing, registry, security

__all__ = ["drift", "history", "lineage", "parsing", "registry", "security"]
