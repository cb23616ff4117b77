"""Lists, vectors and dictionaries written as text."""

from __future__ import annotations

import re

_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")


class _Text:
    def __init__(self, s: str):
        self.s, self.i = s, 0

    def peek(self) -> str:
        while self.i < len(self.s) and self.s[self.i] in " \t\r\n":
            self.i += 1
        return self.s[self.i : self.i + 1]

    def take(self, c: str) -> None:
        if self.peek() != c:
            raise ValueError(f"{c!r} is missing at {self.i}")
        self.i += 1

    def items(self, close: str, item) -> list:
        out = []
        while self.peek() != close:
            if self.peek() == "":
                raise ValueError(f"{close!r} is missing")
            if self.peek() in ",;":
                self.i += 1
                continue
            out.append(item())
        self.i += 1
        return out

    def value(self):
        c = self.peek()
        if c == "[":
            self.i += 1
            return self.items("]", self.value)
        if c == "{":
            self.i += 1
            return dict(self.items("}", self.pair))
        if c in "\"'" and c:
            return self.quoted(c)
        end = re.compile(r"[,;:\]\}\s]").search(self.s, self.i)
        word = self.s[self.i : end.start() if end else len(self.s)]
        if not word:
            raise ValueError(f"a value is missing at {self.i}")
        self.i += len(word)
        return _scalar(word)

    def pair(self):
        key = self.value()
        self.take(":")
        return key, self.value()

    def quoted(self, q: str) -> str:
        out, i = [], self.i + 1
        while i < len(self.s) and self.s[i] != q:
            if self.s[i] == "\\" and i + 1 < len(self.s):
                i += 1
                out.append({"n": "\n", "t": "\t", "r": "\r"}.get(self.s[i], self.s[i]))
            else:
                out.append(self.s[i])
            i += 1
        if i >= len(self.s):
            raise ValueError("a quote isn't closed")
        self.i = i + 1
        return "".join(out)


def _scalar(word: str):
    if _NUMBER.fullmatch(word):
        return float(word) if any(c in word for c in ".eE") else int(word)
    return None if word in ("None", "null", "NA") else word


def parse(text: str):
    """The value that a text stands for: a list, a dictionary, a number, or the text itself."""
    trimmed = text.strip()
    if trimmed[:1] in ("[", "{"):
        reader = _Text(trimmed)
        try:
            value = reader.value()
        except ValueError:
            return text
        return value if reader.peek() == "" else text
    return _scalar(trimmed) if _NUMBER.fullmatch(trimmed) else text
