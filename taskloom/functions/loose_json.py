"""JSON of model answers, read past the slips that models make.

A strict parse is tried first.  Otherwise the value that starts at the first bracket is read as far as it goes: fences and
what stands around the value are left out, strings may have single quotes (and apostrophes or quotes inside), commas may
trail or lack, closers may be missing, keys and words may be bare, and True, False and None count as literals."""

from __future__ import annotations

import json
import re

_FENCE = re.compile(r"```[A-Za-z]*\s*(.*?)(?:```|\Z)", re.DOTALL)
_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?\Z")
_BARE = re.compile(r"[^,:\[\]{}\n]*")
_SPACE = re.compile(r"(?:\s+|//[^\n]*|/\*.*?\*/)*", re.DOTALL)
_LITERALS = {"true": True, "false": False, "null": None, "none": None}


class _Reader:
    def __init__(self, text: str):
        self.text, self.at, self.open = text, 0, []

    def peek(self) -> str:
        """The next character that isn't white space or a comment; empty at the end."""
        self.at = _SPACE.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def value(self):
        c = self.peek()
        if c == "[":
            return self.items()
        if c == "{":
            return self.members()
        return self.string(",]}") if c in "\"'" and c else self.bare()

    def closed(self, own: str) -> bool:
        """Whether the innermost value ends here: at its closer, at the end, or at the closer of one around it (its own is missing)."""
        c = self.peek()
        if not c or c == own:
            self.at += 1
            return True
        return c in "]}" and c in self.open[:-1]

    def items(self) -> list:
        self.at += 1
        self.open.append("]")
        out = []
        while not self.closed("]"):
            if self.peek() in ",}:":
                self.at += 1
            else:
                out.append(self.value())
        self.open.pop()
        return out

    def members(self) -> dict:
        self.at += 1
        self.open.append("}")
        out = {}
        while not self.closed("}"):
            c = self.peek()
            if c in ",]:":
                self.at += 1
                continue
            if c in "[{":  # a value without a key
                self.value()
                continue
            key = self.string(":") if c in "\"'" else self.bare()
            if self.peek() == ":":
                self.at += 1
                out[str(key)] = None if self.peek() in {"", ",", "}"} else self.value()
        self.open.pop()
        return out

    def string(self, ends: str) -> str:
        """A string up to a quote like its first that stands before one of `ends`, or at the end."""
        text, quote = self.text, self.text[self.at]
        start = i = self.at + 1
        while i < len(text):
            if text[i] == "\\":
                i += 2
                continue
            if text[i] == quote:
                after = _SPACE.match(text, i + 1).end()
                if after >= len(text) or text[after] in ends:
                    break
            i += 1
        body, self.at = text[start:i], i + 1
        body = body.replace("\\'", "'") if quote == "'" else body
        try:
            return json.loads('"' + re.sub(r'(?<!\\)"', r"\"", body).replace("\n", "\\n").replace("\t", "\\t") + '"')
        except ValueError:
            return body

    def bare(self):
        m = _BARE.match(self.text, self.at)
        word = m[0].strip().strip("\"'")
        self.at = max(m.end(), self.at + 1)
        if word.lower() in _LITERALS:
            return _LITERALS[word.lower()]
        if _NUMBER.match(word):
            return float(word) if re.search(r"[.eE]", word) else int(word)
        return word


def loose_json(text: str | None):
    """The list or object of a text; None without one.  A strict JSON text may be any value."""
    text = (text or "").strip()
    if fence := _FENCE.search(text):
        text = fence[1].strip() or text
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        pass
    first = min((i for i in (text.find("["), text.find("{")) if i >= 0), default=-1)
    if first < 0:
        return None
    try:
        return _Reader(text[first:]).value()
    except RecursionError:
        return None
