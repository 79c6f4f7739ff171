"""A pluggable finder of persons' names in prose; the default knows a list of names, no model."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from . import vocab


def gazetteer(names: Iterable[str] = ()) -> Callable[[str], list[tuple[int, int]]]:
    """Finder of runs of one to three capitalised words of which one is a known name. The list is sent with
    the function, so it is meant for thousands, not millions, of names."""
    known = frozenset(w for n in names for w in n.split()) or frozenset(w for t in (vocab.FIRST, vocab.LAST) for ws in t.values() for w in ws)
    run = re.compile(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+){0,2}\b")

    def find(text: str) -> list[tuple[int, int]]:
        return [(m.start(), m.end()) for m in run.finditer(text or "") if m.end() - m.start() >= 2 and any(w in known for w in m[0].split())]

    return find
