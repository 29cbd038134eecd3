"""Parsers by file extension: how a project's files become stage rows."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.operators import parse

#: A parser of another version of the protocol is refused.
PROTOCOL = 1


class Parser(Protocol):
    """`protocol` is `PROTOCOL`; both functions take and give DataFrames, (path, raw) to what `weirflow.operators.parse` returns."""

    protocol: int

    def stages(self, files: DataFrame) -> DataFrame: ...

    def diagnostics(self, files: DataFrame) -> DataFrame: ...


class SqlParser:
    """SQL with template regions: the parser of the library."""

    protocol = PROTOCOL

    def stages(self, files: DataFrame) -> DataFrame:
        return parse.stages(files)

    def diagnostics(self, files: DataFrame) -> DataFrame:
        return parse.diagnostics(files)


PARSERS: dict[str, Parser] = {"sql": SqlParser()}


def register(extension: str, parser: Parser) -> None:
    """Parse files of an extension (without its dot) with `parser`; one that is taken, or a parser of another protocol, is an error."""
    extension = extension.lower()
    if getattr(parser, "protocol", None) != PROTOCOL:
        raise ValueError(f"a parser of protocol {PROTOCOL} is needed")
    if extension in PARSERS:
        raise ValueError(f"extension {extension!r} has a parser")
    PARSERS[extension] = parser


def _each(files: DataFrame, name: str) -> DataFrame:
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    found = [getattr(p, name)(files.where(ext == e)) for e, p in PARSERS.items()]
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out


def stages(files: DataFrame) -> DataFrame:
    """Stage rows of (path, raw), each file by the parser of its extension; others give none."""
    return _each(files, "stages")


def diagnostics(files: DataFrame) -> DataFrame:
    return _each(files, "diagnostics")
