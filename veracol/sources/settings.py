"""Settings from KEY=VALUE lines and the environment."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping


def parse_lines(lines: Iterable[str]) -> dict[str, str]:
    """KEY=VALUE lines: quotes are taken off, ` #` opens a comment outside quotes, the first line of a key counts."""
    out: dict[str, str] = {}
    for line in lines:
        name, eq, value = line.strip().partition("=")
        name, value = name.strip(), value.strip()
        if not eq or not name or name.startswith("#"):
            continue
        if len(value) > 1 and value[0] in "\"'" and value.find(value[0], 1) > 0:
            value = value[1 : value.find(value[0], 1)]
        else:
            value = value.partition(" #")[0].rstrip()
        out.setdefault(name, value)
    return out


def settings(lines: Iterable[str] = (), environment: Mapping[str, str] | None = None) -> dict[str, str]:
    """Settings of the lines; the environment's values win."""
    environment = os.environ if environment is None else environment
    out = parse_lines(lines)
    return {k: environment.get(k, v) for k, v in out.items()}
