"""Tolerant JSON, where no built-in function has the semantics: Arrow-batched functions that give standard JSON text."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_LITERALS = {"true": True, "false": False, "null": None}
_BARE = re.compile(r"[^\s,:\[\]{}]+")


class _Reader:
    """Recursive descent over one text: single, double or triple quotes, trailing commas, bare keys, literals in any case."""

    def __init__(self, text: str):
        self.s, self.i = text, 0

    def space(self) -> None:
        while self.i < len(self.s) and self.s[self.i].isspace():
            self.i += 1

    def peek(self) -> str:
        self.space()
        if self.i >= len(self.s):
            raise ValueError("unexpected end")
        return self.s[self.i]

    def value(self, depth: int = 0):
        if depth > 200:
            raise ValueError("too deep")
        c = self.peek()
        if c == "{":
            return self.collect("}", depth)
        if c == "[":
            return self.collect("]", depth)
        if c in "\"'":
            return coerce(self.text())
        word = _BARE.match(self.s, self.i)
        if not word:
            raise ValueError(f"unexpected {c!r} at {self.i}")
        self.i = word.end()
        found = coerce(word.group())
        if isinstance(found, str):
            raise ValueError(f"unexpected word {found!r}")
        return found

    def collect(self, end: str, depth: int):
        self.i += 1
        out: list = []
        while self.peek() != end:
            if end == "}":
                key = self.text() if self.peek() in "\"'" else self.bare()
                if self.peek() != ":":
                    raise ValueError("no colon")
                self.i += 1
                out.append((key, self.value(depth + 1)))
            else:
                out.append(self.value(depth + 1))
            if self.peek() == ",":
                self.i += 1
            elif self.peek() != end:
                raise ValueError("no comma")
        self.i += 1
        return dict(out) if end == "}" else out

    def bare(self) -> str:
        word = _BARE.match(self.s, self.i)
        if not word:
            raise ValueError("no key")
        self.i = word.end()
        return word.group()

    def text(self) -> str:
        quote = self.s[self.i]
        if self.s.startswith(quote * 3, self.i):
            end = self.s.find(quote * 3, self.i + 3)
            if end < 0:
                raise ValueError("open triple quote")
            found, self.i = self.s[self.i + 3 : end], end + 3
            return found
        out, i = [], self.i + 1
        while i < len(self.s) and self.s[i] != quote:
            if self.s[i] == "\\" and i + 1 < len(self.s):
                e = self.s[i + 1]
                if e == "u" and re.fullmatch("[0-9a-fA-F]{4}", self.s[i + 2 : i + 6]):
                    out.append(chr(int(self.s[i + 2 : i + 6], 16)))
                    i += 6
                    continue
                out.append({"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}.get(e, e))
                i += 2
                continue
            out.append(self.s[i])
            i += 1
        if i >= len(self.s):
            raise ValueError("open quote")
        self.i = i + 1
        return "".join(out)


def coerce(word: str):
    """Literals and numbers by their looks; anything else stays text."""
    if word.lower() in _LITERALS:
        return _LITERALS[word.lower()]
    try:
        number = float(word) if "." in word or "e" in word.lower() else int(word)
    except ValueError:
        return word
    return word if number in (float("inf"), float("-inf")) or number != number else number


def parse_lenient(text: str | None):
    """Value of the outermost braces or brackets of a text; ValueError where there is none or it does not parse."""
    if not text:
        raise ValueError("empty")
    begins = [x for x in (text.find("{"), text.find("[")) if x >= 0]
    if not begins:
        raise ValueError("no braces")
    begin = min(begins)
    end = text.rfind("}" if text[begin] == "{" else "]")
    if end < begin:
        raise ValueError("not closed")
    return _Reader(text[begin : end + 1]).value()


def first_array(text: str | None) -> str | None:
    """The first balanced [...]; brackets inside strings count too."""
    if not text or "[" not in text:
        return None
    depth = 0
    for m in re.finditer(r"[\[\]]", text[text.index("[") :]):
        depth += 1 if m.group() == "[" else -1
        if depth == 0:
            at = text.index("[")
            return text[at : at + m.end()]
    return None


def json_or_literal(text: str | None):
    """JSON, else a Python literal; ValueError if it is neither."""
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        try:
            return ast.literal_eval(text)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            raise ValueError("neither JSON nor literal") from None


def _as_json(f):
    def one(text):
        try:
            return json.dumps(f(text), ensure_ascii=False, default=str)
        except (ValueError, RecursionError):
            return None

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action=None).astype(object).where(lambda x: x.notna(), None)

    return convert


def lenient_json(c: Column) -> Column:
    """Standard JSON of a sloppily written object or array; null where it cannot be read."""
    return _as_json(parse_lenient)(c)


def literal_json(c: Column) -> Column:
    return _as_json(json_or_literal)(c)


def first_array_text(c: Column) -> Column:
    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(first_array, na_action=None).astype(object).where(lambda x: x.notna(), None)

    return find(c)
