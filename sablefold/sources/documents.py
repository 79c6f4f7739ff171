"""JSON files read piece by piece: objects and lists are walked, one value is held at once."""

from __future__ import annotations

import json
from collections.abc import Iterator

#: Characters read at once, at least.
CHUNK = 1 << 20


class Reader:
    """One JSON text. Whoever walks ``items`` or ``elements`` takes each value before the next step. Text that
    is no JSON raises ValueError."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            encoding = json.detect_encoding(f.read(4))
        self._file = open(path, encoding=encoding, newline="")
        self._text, self._at, self._ended = "", 0, False
        self._decode = json.JSONDecoder().raw_decode

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_: object) -> None:
        self._file.close()

    def _more(self) -> None:
        rest = self._text[self._at :]
        new = self._file.read(max(CHUNK, len(rest)))
        self._text, self._at, self._ended = rest + new, 0, not new

    def peek(self) -> str:
        """The next character that is no white space, "" at the end."""
        while True:
            text, at = self._text, self._at
            while at < len(text) and text[at] in " \t\n\r":
                at += 1
            self._at = at
            if at < len(text):
                return text[at]
            if self._ended:
                return ""
            self._more()

    def _take(self, wanted: str) -> str:
        c = self.peek()
        if not c or c not in wanted:
            raise ValueError(f"no JSON: one of {wanted} expected")
        self._at += 1
        return c

    def value(self) -> object:
        self.peek()
        while True:
            try:
                found, end = self._decode(self._text, self._at)
            except json.JSONDecodeError:
                if self._ended:
                    raise
            else:
                if end < len(self._text) or self._ended:  # a number may go on
                    self._at = end
                    return found
            self._more()

    def items(self) -> Iterator[str]:
        """Keys of an object."""
        self._take("{")
        if self.peek() == "}":
            self._at += 1
            return
        while True:
            if self.peek() != '"':
                raise ValueError("no JSON: a key expected")
            key = self.value()
            self._take(":")
            yield key
            if self._take(",}") == "}":
                return

    def elements(self) -> Iterator[int]:
        """Numbers of a list's elements."""
        self._take("[")
        if self.peek() == "]":
            self._at += 1
            return
        n = 0
        while True:
            yield n
            n += 1
            if self._take(",]") == "]":
                return

    def skip(self, depth: int) -> None:
        """Past one value; down to ``depth`` its parts are taken one by one."""
        c = self.peek()
        if not depth or not c or c not in "{[":
            self.value()
            return
        for _ in self.items() if c == "{" else self.elements():
            self.skip(depth - 1)

    def end(self) -> None:
        if self.peek():
            raise ValueError("no JSON: extra data")
