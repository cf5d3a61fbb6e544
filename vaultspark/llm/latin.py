"""Splitting patterns for texts of common Latin characters, with classes written out for the standard library's matcher, which is faster.

SAFE texts hold only characters on which all Unicode tables agree; others need the pattern as it is.
"""

from __future__ import annotations

import re

import regex

_SAFE = "\t\n\r -~¡-¬®-įı-ž‐-‧€"
SAFE = re.compile(f"[{_SAFE}]*")


def _ranges(chars: list[str]) -> str:
    out, k = "", 0
    while k < len(chars):
        j = k
        while j + 1 < len(chars) and ord(chars[j + 1]) == ord(chars[j]) + 1:
            j += 1
        out += chars[k] if j == k else f"{chars[k]}-{chars[j]}"
        k = j + 1
    return out


def splitter(pattern: str):
    """findall for SAFE texts of a pattern with the classes \\p{L}, \\p{N} and \\s."""
    every = [c for c in map(chr, range(0x2100)) if SAFE.fullmatch(c)]
    letters, numbers = (_ranges([c for c in every if regex.match(p, c)]) for p in (r"\p{L}", r"\p{N}"))
    inside = lambda m: m[0].replace(r"\p{L}", letters).replace(r"\p{N}", numbers)
    out = re.sub(r"\[[^\]]*\]", inside, pattern)
    return re.compile(out.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")).findall
