"""Number literals of the subject language as exact integers, and identifiers taken apart."""

from __future__ import annotations

import re
from fractions import Fraction

UNITS = {"": 1, "wei": 1, "gwei": 10**9, "ether": 10**18, "seconds": 1, "minutes": 60, "hours": 3600, "days": 86400, "weeks": 604800}
LARGEST = 2**256 - 1
_DIGITS = r"[0-9](?:_?[0-9])*"
_DECIMAL = re.compile(rf"({_DIGITS})?(?:\.({_DIGITS}))?(?:[eE](-?{_DIGITS}))?")
_HEX = re.compile(r"0[xX]([0-9a-fA-F](?:_?[0-9a-fA-F])*)")


def integer_constant(text: str, unit: str = "") -> int | None:
    """The value of a literal with its unit: underscores, hexadecimal digits, fractions and exponents, as long as it comes out whole and fits in 256 bits; else None.

    Rationals are exact, so 0.5 ether is a whole number of wei; an exponent beyond 256 bits' worth of digits is refused before it is computed."""
    if unit not in UNITS:
        return None
    if m := _HEX.fullmatch(text):
        value = Fraction(int(m[1].replace("_", ""), 16)) if not unit else None  # hexadecimal literals take no unit
    elif (m := _DECIMAL.fullmatch(text)) and (m[1] or m[2]):
        whole, part, power = (x.replace("_", "") if x else "" for x in m.groups())
        if len(power.lstrip("-")) > 4 or abs(int(power or 0)) > 4096:
            return None
        value = Fraction(int((whole + part) or 0), 10 ** len(part)) * Fraction(10) ** int(power or 0) * UNITS[unit]
    else:
        return None
    return int(value) if value is not None and value.denominator == 1 and 0 <= value <= LARGEST else None


def canonical_literal(text: str, kind: str = "", subtype: str = "", unit: str = "") -> str:
    """One text for all ways to write a literal: integer:<value> for numbers, else the kind and subtype with the text as it stands."""
    value = integer_constant(text, unit) if kind in ("", "number") else None
    return f"integer:{value}" if value is not None else f"{kind}:{subtype}:{text}"


def function_id(path: str, contract: str, selector: str) -> str:
    return f"{path}#{contract}.{selector}"


def parse_function_id(identity: str) -> tuple[str, str, str]:
    """Path, contract and selector; all of it is the path where no # is in it."""
    path, mark, rest = identity.partition("#")
    contract, _, selector = rest.partition(".")
    return (path, contract, selector) if mark else (identity, "", "")


def parse_contract_id(identity: str) -> tuple[str, str]:
    """Path and contract; all of it is the contract where no # is in it."""
    path, mark, name = identity.partition("#")
    return (path, name) if mark else ("", identity)
