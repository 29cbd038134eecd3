"""A small SQL tokenizer for the rewrite rules, which edit one file's text at a time."""

from __future__ import annotations

import re
from typing import NamedTuple

_PIECE = re.compile(r"--[^\n]*|/\*.*?\*/|(?P<template>\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})|(?P<string>'(?:[^'\n]|'')*')|(?P<quoted>\"[^\"\n]*\"|`[^`\n]*`)|(?P<number>\d[\d._]*)|(?P<word>[^\W\d]\w*)|(?P<op><=|>=|<>|!=|\|\||::|->|:=|==|\S)", re.S)


class Token(NamedTuple):
    kind: str
    value: str
    start: int
    end: int
    depth: int

    def is_(self, *words: str) -> bool:
        return self.kind == "word" and self.value.upper() in words


def tokenize(text: str) -> list[Token]:
    """Tokens without spaces and comments; a template region is one token; brackets carry the depth outside them."""
    out: list[Token] = []
    depth = 0
    for m in _PIECE.finditer(text):
        if m.lastgroup is None:
            continue
        if m.group() in (")", "]"):
            depth = max(0, depth - 1)
        out.append(Token(m.lastgroup, m.group(), m.start(), m.end(), depth))
        if m.group() in ("(", "["):
            depth += 1
    return out


def closing(toks: list[Token], i: int) -> int | None:
    """Place of the bracket that closes the one at i."""
    return next((k for k in range(i + 1, len(toks)) if toks[k].value in (")", "]") and toks[k].depth == toks[i].depth), None)
