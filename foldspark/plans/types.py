"""Event-type hierarchies."""

from __future__ import annotations


class TypeRegistry:
    """Parents of event types. A type has one parent at most; ``root`` is above all, if named."""

    def __init__(self, parents: dict[str, str] | None = None, root: str | None = None) -> None:
        self.parents, self.root = dict(parents or {}), root
        for t in self.parents:
            self.ancestors(t)

    def ancestors(self, event_type: str) -> list[str]:
        found = []
        while event_type in self.parents:
            event_type = self.parents[event_type]
            if event_type in found:
                raise ValueError(f"{event_type} is its own ancestor")
            found.append(event_type)
        return found + ([self.root] if self.root and self.root not in found else [])

    def types(self) -> list[str]:
        return list(dict.fromkeys([*self.parents, *self.parents.values()]))

    def base_of(self, event_type: str, mapped: list[str]) -> str | None:
        """The one base type whose handlers run for an event: of the mapped types, the first registered that is an ancestor."""
        above = set(self.ancestors(event_type)) - {event_type}
        return next((m for m in mapped if m in above), None)
