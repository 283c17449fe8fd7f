"""Values of a configuration, read on the driver before any plan: references to the environment, the clock, run ids and modes."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime

# How a reference is written, and the spellings of modes.
OPEN, CLOSE = "${", "}"
MODES = {"EvidenceOnly": "evidence_only", "WithExpertResults": "with_expert_results"}


class Missing(KeyError):
    """All references of a configuration that have no value, each with the path where it stands."""

    def __init__(self, places: list[tuple[str, str]]):
        super().__init__("; ".join(f"{path}: {name}" for path, name in places))
        self.places = places


def leaves(value: object, path: str = "$") -> Iterator[tuple[str, object, object, object]]:
    """(path, holder, key, leaf) of everything in dicts and lists that is neither."""
    stack: list[tuple[str, object, object, object]] = [(path, None, None, value)]
    while stack:
        at, holder, key, v = stack.pop()
        if isinstance(v, dict):
            stack += [(f"{at}.{k}", v, k, x) for k, x in v.items()]
        elif isinstance(v, list):
            stack += [(f"{at}[{k}]", v, k, x) for k, x in enumerate(v)]
        else:
            yield at, holder, key, v


def reference(value: object) -> str | None:
    """The name that a string refers to if it is a reference and nothing else."""
    if not isinstance(value, str) or not value.startswith(OPEN) or not value.endswith(CLOSE):
        return None
    name = value[len(OPEN) : -len(CLOSE)]
    return name if name.isascii() and name.isidentifier() else None


def resolve(config: dict, environment: Mapping[str, str] | None = None) -> dict:
    """config with its references replaced in place. All that are unset or empty are reported together, before anything is replaced."""
    names = os.environ if environment is None else environment
    found = [(path, holder, key, name) for path, holder, key, v in leaves(config) if (name := reference(v)) is not None]
    missing = sorted((path, name) for path, _, _, name in found if not names.get(name))
    if missing:
        raise Missing(missing)
    for _, holder, key, name in found:
        holder[key] = names[name]
    return config


@dataclass(frozen=True)
class Clock:
    """One source of time for a run: its stamps and its ids come from the same readings."""

    read: Callable[[], datetime] = field(default=lambda: datetime.now(UTC))

    def stamp(self) -> str:
        """UTC to the second. Not for anything that is hashed."""
        return f"{self.read().astimezone(UTC):%Y-%m-%dT%H:%M:%S}+00:00"

    def run_id(self, pattern: str = "run-%Y%m%d-%H%M%S") -> str:
        """An id by the caller's pattern, in the zone of the readings."""
        return format(self.read(), pattern)


def mode(value: str) -> str:
    """A mode's one spelling, from either."""
    if value in MODES.values():
        return value
    if value not in MODES:
        raise ValueError(f"unknown mode {value!r}")
    return MODES[value]
