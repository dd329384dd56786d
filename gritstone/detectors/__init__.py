"""The detectors: each says what goes wrong, in terms that they share."""

from __future__ import annotations

from gritstone.detectors.catalogue import DETECTORS, PROBES
from gritstone.wql.rules import SEVERITIES, Template, parse

__all__ = ["pack", "probes"]


def _ordered(texts: list[str]) -> list[Template]:
    return sorted(map(parse, texts), key=lambda t: (SEVERITIES.index(t.severity), t.id))


def pack() -> list[Template]:
    """All detectors, worst first."""
    return _ordered(DETECTORS)


def probes() -> list[Template]:
    """Templates that show single features of the language at work, not bugs."""
    return _ordered(PROBES)
