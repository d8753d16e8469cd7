"""Named sources: a name stands for a kind and a place."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

KINDS = ("files", "table", "traces")


@dataclass(frozen=True)
class Source:
    """Where events live.

    ``files`` needs ``root``; ``table`` needs one of ``table``, ``path``, ``jdbc`` in
    ``options`` and may set ``case_sensitive`` and the partition columns ``org_col`` and ``date_col``;
    ``traces`` needs ``path`` in ``options``. Traces belong to nobody in particular unless ``tenant_col`` names the column
    with their tenant.
    ``base_uri``, ``internal_uri`` and ``public_uri`` shape the locations in manifests.
    """

    name: str
    kind: str
    root: str = ""
    case_sensitive: bool = False
    base_uri: str = ""
    internal_uri: str = ""
    public_uri: str = ""
    ttl_seconds: int = 3600
    org_col: str | None = None
    date_col: str | None = None
    tenant_col: str | None = None
    options: dict = field(default_factory=dict)


class Sources:
    """An ordered set of named sources."""

    def __init__(self, sources: Iterable[Source] = ()):
        self._sources = tuple(sources)

    def __iter__(self):
        return iter(self._sources)

    def resolve(self, name: str, kind: str | None = None) -> Source:
        """The first source of that name; ``KeyError`` if unknown, ``ValueError`` if of another kind."""
        for source in self._sources:
            if source.name == name:
                if kind is not None and source.kind != kind:
                    raise ValueError(f"source {name!r} is of kind {source.kind!r}, not {kind!r}")
                return source
        raise KeyError(f"source {name!r} not found")
