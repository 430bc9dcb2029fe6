"""The standard scope and name lists every operator shares."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Scope:
    influencers: tuple[str, ...]
    recipients: tuple[str, ...]
    categories: tuple[str, ...] = ()
    subcategories: tuple[str, ...] = ()
    start: str = "2024-08-01"
    end: str = "2026-07-01"  # exclusive
    aliases: dict[str, str] = field(default_factory=dict)
    groups: dict[str, tuple[str, ...]] = field(default_factory=dict)


#: The scope of the test tables.
TEST_SCOPE = Scope(
    influencers=tuple(f"NATION_{i}" for i in range(5)),
    recipients=tuple(f"NATION_{i}" for i in range(19)),
    categories=("ECONOMY", "LARGE", "MEDIUM", "SMALL"),
    start="1996-01-01",
    end="2001-01-01",
    aliases={"NATION_18": "NATION_17"},
    groups={"first five": tuple(f"NATION_{i}" for i in range(5))},
)
