"""Predicates as plan-time trees that compile to one column, so that Catalyst pushes what it can.

Tag modes: ANY and ALL admit untagged rows, their strict forms do not, EXACT is
set equality (an empty request: untagged rows only).  A null array counts as untagged.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, functions as F

MODES = ("any", "all", "any_strict", "all_strict", "exact")


def _tags() -> Column:
    return F.coalesce(F.col("tags"), F.array().cast("array<string>"))


def _array(tags: list[str]) -> Column:
    return F.array(*map(F.lit, tags)).cast("array<string>")


def _match(tags: list[str], mode: str) -> Column:
    own, req = _tags(), _array(tags)
    untagged = F.size(own) == 0
    if mode in ("any", "any_strict"):
        hit = F.arrays_overlap(own, req)
    elif mode in ("all", "all_strict"):
        hit = F.size(F.array_except(req, own)) == 0
    elif mode == "exact":
        return ~untagged & (F.array_sort(F.array_distinct(own)) == F.array_sort(F.array_distinct(req))) if tags else untagged
    else:
        raise ValueError(f"unknown tag mode {mode}")
    return ~untagged & hit if mode.endswith("strict") else untagged | hit


def tag_filter(tags: list[str], mode: str = "any") -> Column:
    """Top-level filter: an empty request filters nothing, but for EXACT."""
    if mode not in MODES:
        raise ValueError(f"unknown tag mode {mode}")
    return F.lit(True) if not tags and mode != "exact" else _match(tags, mode)


@dataclass(frozen=True)
class Leaf:
    tags: list[str]
    mode: str = "any"

    def column(self) -> Column:
        """In a tree an empty request keeps its own meaning for each mode."""
        if self.tags:
            return _match(self.tags, self.mode)
        untagged = F.size(_tags()) == 0
        return {"any": untagged, "all": F.lit(True), "any_strict": F.lit(False), "all_strict": ~untagged, "exact": untagged}[self.mode]


@dataclass(frozen=True)
class All:
    parts: list

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (p.column() for p in self.parts), F.lit(True))


@dataclass(frozen=True)
class Any_:
    parts: list

    def column(self) -> Column:
        return reduce(lambda a, b: a | b, (p.column() for p in self.parts), F.lit(False))


@dataclass(frozen=True)
class Not:
    part: object

    def column(self) -> Column:
        return ~self.part.column()  # type: ignore[attr-defined]


def wire_filter(tags: list[str], mode: str | int | None = None, groups: list | None = None) -> Column:
    """A request's filter: tags in a mode (by name or number, ANY where unset) and trees, all of which must hold."""
    name = MODES[mode] if isinstance(mode, int) else (mode or "any").lower()
    return reduce(lambda a, b: a & b, (_tree_in(g).column() if isinstance(g, dict) else g.column() for g in groups or []), tag_filter(tags, name))


def _tree_out(node) -> dict:  # type: ignore[no-untyped-def]
    if isinstance(node, Leaf):
        return {"tags": node.tags, "mode": node.mode}
    if isinstance(node, Not):
        return {"not": _tree_out(node.part)}
    return {"all" if isinstance(node, All) else "any": [_tree_out(x) for x in node.parts]}


def _tree_in(plain: dict):  # type: ignore[no-untyped-def]
    if "tags" in plain:
        return Leaf(plain["tags"], plain.get("mode", "any"))
    if "not" in plain:
        return Not(_tree_in(plain["not"]))
    return All([_tree_in(x) for x in plain["all"]]) if "all" in plain else Any_([_tree_in(x) for x in plain["any"]])


def cluster_may_match(tags: list[str], mode: str = "any") -> Column:
    """What tags (a union) and has_untagged of a cluster must meet for it to hold a row that passes: needed, not enough."""
    own, req = F.col("tags"), _array(tags)
    if not tags:
        return F.col("has_untagged") if mode == "exact" else F.lit(True)
    hit = F.arrays_overlap(own, req) if mode in ("any", "any_strict") else F.size(F.array_except(req, own)) == 0
    return hit if mode.endswith("strict") or mode == "exact" else F.col("has_untagged") | hit


def cluster_may_be_updated(since: int | None, until: int | None) -> Column:
    """The same for a window of updates (exclusive) over updated_from and updated_to; a cluster without any update time holds no such row."""
    if since is None and until is None:
        return F.lit(True)
    out = F.col("updated_to").isNotNull()
    if since is not None:
        out &= F.col("updated_to") > since
    if until is not None:
        out &= F.col("updated_from") < until
    return F.coalesce(out, F.lit(False))


@dataclass(frozen=True)
class Predicate:
    """AND of all that is set; the window's bounds are exclusive and a null updated_at fails a bound."""

    memory_types: list[int] = field(default_factory=list)
    metadata_equals: dict[str, str] = field(default_factory=dict)
    tags: list[str] = field(default_factory=list)
    mode: str = "any"
    groups: list = field(default_factory=list)
    updated_from: int | None = None
    updated_to: int | None = None

    def to_json(self) -> str:
        """As it stands in the log."""
        plain = asdict(self) | {"groups": [_tree_out(g) for g in self.groups]}
        return json.dumps({k: v for k, v in plain.items() if v not in ([], {}, None)}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Predicate:
        plain = json.loads(text)
        return cls(**plain | {"groups": [_tree_in(g) for g in plain.get("groups", [])]})

    def summary(self) -> str:
        """For a log listing."""
        parts = [f"types={sorted(self.memory_types)}"] if self.memory_types else []
        parts += [f"{k}={v}" for k, v in sorted(self.metadata_equals.items())]
        parts += [f"tags {self.mode} {sorted(self.tags)}"] if self.tags or self.mode == "exact" else []
        parts += [f"{len(self.groups)} tag groups"] if self.groups else []
        parts += [f"updated_at > {self.updated_from}"] if self.updated_from is not None else []
        parts += [f"updated_at < {self.updated_to}"] if self.updated_to is not None else []
        return " and ".join(parts) or "everything"

    def is_empty(self) -> bool:
        return not (self.memory_types or self.metadata_equals or self.tags or self.mode == "exact" or self.groups or self.updated_from is not None or self.updated_to is not None)

    def column(self) -> Column:
        parts = [tag_filter(self.tags, self.mode), *(g.column() for g in self.groups)]
        if self.memory_types:
            parts.append(F.col("memory_type").isin(*sorted(set(self.memory_types))))
        parts += [F.coalesce(F.col("metadata")[k] == v, F.lit(False)) for k, v in sorted(self.metadata_equals.items())]
        if self.updated_from is not None:
            parts.append(F.coalesce(F.col("updated_at") > self.updated_from, F.lit(False)))
        if self.updated_to is not None:
            parts.append(F.coalesce(F.col("updated_at") < self.updated_to, F.lit(False)))
        return reduce(lambda a, b: a & b, parts)


def require_constraint(predicate: Predicate, delete_all: bool = False) -> None:
    """Guard of deletes: an empty predicate would delete everything."""
    if predicate.is_empty() and not delete_all:
        raise ValueError("an empty predicate needs delete_all")
