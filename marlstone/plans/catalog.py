"""Sources, their relations and indexes: what a configuration declares."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

ONE = ("hasOne", "hasOneThrough")
DIRECT = ("hasOne", "hasMany", "belongsTo", "belongsToMany")
THROUGH = ("hasOneThrough", "hasManyThrough")
INVERSE = ("belongsTo", "belongsToMany")
DEFAULT_DEPTH, DEPTHS = 1, range(1, 11)


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Relation:
    """local values of the owner meet foreign values of the target; through relations meet twice."""

    to: str
    kind: str
    local: str
    foreign: str
    through: str | None = None
    through_foreign: str | None = None
    through_local: str | None = None

    def __post_init__(self):
        if self.kind not in (*DIRECT, *THROUGH):
            raise ConfigError(f"Unknown relation type: {self.kind}")
        if (self.kind in THROUGH) != (self.through is not None):
            raise ConfigError(f"{self.kind} needs {'a' if self.kind in THROUGH else 'no'} through source")

    @classmethod
    def from_json(cls, spec: Mapping[str, Any]) -> Relation:
        kind = spec["type"]
        if kind in THROUGH:
            return cls(spec["to"], kind, spec["sourceLocalKey"], spec["targetForeignKey"], spec["through"], spec["throughForeignKey"], spec["throughLocalKey"])
        return cls(spec["to"], kind, spec["localKey"], spec["foreignKey"])


@dataclass(frozen=True)
class Source:
    """kind is a parser's name, or "table" for a columnar table whose slug is made of the key columns."""

    name: str
    kind: str
    pattern: str
    schema: Mapping[str, Any] = field(default_factory=dict)
    key: tuple[str, ...] = ()
    relations: Mapping[str, Relation] = field(default_factory=dict)
    index: Mapping[str, int] = field(default_factory=dict)
    custom_index: Mapping[str, int] = field(default_factory=dict)
    root: str | None = None


def _depth(name: str, spec: Any) -> int:
    depth = (spec or {}).get("indexDepth", DEFAULT_DEPTH) if not isinstance(spec, int) else spec
    if depth not in DEPTHS:
        raise ConfigError(f"index depth {depth} of '{name}' out of range (1-10)")
    return depth


class Catalog(Mapping[str, Source]):
    def __init__(self, sources: Mapping[str, Source]):
        self._sources = {n: replace(s, index={f: _depth(f, d) for f, d in s.index.items()}, custom_index={f: _depth(f, d) for f, d in s.custom_index.items()}) for n, s in sources.items()}
        for source in self._sources.values():
            for relation in source.relations.values():
                for other in (relation.to, relation.through):
                    if other is not None and other not in self._sources:
                        raise ConfigError(f"Source not found: {other}")

    @classmethod
    def from_json(cls, config: str | Mapping[str, Any]) -> Catalog:
        spec = json.loads(config) if isinstance(config, str) else config
        return cls(
            {
                name: Source(
                    name, s["type"], s.get("pattern", ""), s.get("schema") or {}, tuple(s.get("key") or ()),
                    {n: Relation.from_json(r) for n, r in (s.get("relations") or {}).items()},
                    {f: _depth(f, d) for f, d in (s.get("index") or {}).items()}, {f: _depth(f, d) for f, d in (s.get("customIndex") or {}).items()}, s.get("root"),
                )
                for name, s in spec.get("sources", {}).items()
            }
        )

    def __getitem__(self, name: str) -> Source:
        if name not in self._sources:
            raise ConfigError(f"Source not found: {name}")
        return self._sources[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._sources)

    def __len__(self) -> int:
        return len(self._sources)

    def indexes(self, name: str) -> dict[str, int]:
        """Every field of a source that has an index, with its depth: slug, keys of relations on either side, declared, custom."""
        source, found = self[name], {"slug": DEFAULT_DEPTH}
        for owner in self._sources.values():
            for relation in owner.relations.values():
                keys = [(owner.name, relation.local), (relation.to, relation.foreign)]
                if relation.through is not None:
                    keys += [(relation.through, relation.through_foreign), (relation.through, relation.through_local)]
                found |= {k: DEFAULT_DEPTH for at, k in keys if at == name}
        return found | dict(source.index) | dict(source.custom_index)
