"""Patterns of the rules for two engines: columns (Java) and Arrow batches (Python).

The rules' patterns count ASCII letters, digits and the underscore as parts of words, and every Unicode blank as white
space. Neither engine reads ``\\b``, ``\\w`` and ``\\s`` so by default, hence the translation.
"""

from __future__ import annotations

import re
from functools import lru_cache

# White space beyond ASCII. Fixed values.
_BLANKS = r"   -     　﻿"
_WORD = "[A-Za-z0-9_]"
_STARTS, _ENDS = f"(?<!{_WORD})", f"(?!{_WORD})"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def _translated(pattern: str, edges: bool) -> str:
    """``pattern`` with its ``\\s``, ``\\S`` and, with ``edges``, ``\\b`` spelt out."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(r"\s" + _BLANKS if in_class else rf"[\s{_BLANKS}]")
        elif two == r"\S" and not in_class:
            out.append(rf"[^\s{_BLANKS}]")
        elif two == r"\b" and not in_class and edges:
            before, after = pattern[:i], pattern[i + 2 :]
            if re.match(r"(?:\(\?:|\((?!\?))*(?:\w|\[A-Za-z_)", after):
                out.append(_STARTS)
            elif re.search(r"\w\Z|[\])][*+?]?\Z", before):
                out.append(_ENDS)
            else:
                out.append(_EDGE)
        elif two[0] == "\\":
            out.append(two)
        else:
            in_class = two[0] == "[" or in_class and two[0] != "]"
            out.append(two[0])
            i += 1
            continue
        i += 2
    return "".join(out)


@lru_cache(maxsize=None)
def java(pattern: str) -> str:
    """The pattern for Spark's regular expressions."""
    return _translated(pattern, True)


@lru_cache(maxsize=None)
def python(pattern: str, flags: int = 0) -> re.Pattern:
    """The pattern compiled for Python."""
    return re.compile(_translated(pattern, False), flags | re.ASCII)
