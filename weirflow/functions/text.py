"""Scalar text functions as Spark columns: positions, entropy, redaction, quoting, canonical hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of secrets that redaction must cover.
SECRET_PREFIX = r"(sk-[A-Za-z0-9]{16,}|ghp_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}|xox[baprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{20,})"
SECRET_KEYS = r"(?:password|passwd|api[_-]?key|token|secret|client[_-]?secret)"
SECRET_ASSIGNMENT = rf"({SECRET_KEYS})\s*[:=]\s*['\"]?[^'\"\s,;)]{{6,}}['\"]?"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def line_of(text: Column | str, offset: Column | str) -> Column:
    """1-based line of a 0-based code-point offset."""
    before = F.substring(col(text), F.lit(1), col(offset).cast("int"))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1


def column_of(text: Column | str, offset: Column | str) -> Column:
    """1-based column of a 0-based code-point offset."""
    before = F.substring(col(text), F.lit(1), col(offset).cast("int"))
    return F.length(F.substring_index(before, "\n", -1)) + 1


def line_text(text: Column | str, offset: Column | str) -> Column:
    """The whole line that holds a 0-based code-point offset."""
    start = col(offset).cast("int") - column_of(text, offset) + 1
    return F.substring_index(F.substring(col(text), start + 1, F.length(col(text))), "\n", 1)


def entropy(text: Column | str) -> Column:
    """Shannon entropy in bits a character; 0 for empty text."""
    chars = F.split(col(text), "")
    n = F.length(col(text))
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    total = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    return F.when(n == 0, F.lit(0.0)).otherwise(total)


def redact(text: Column | str) -> Column:
    """Secret shapes become `<redacted>`; the key of an assignment stays."""
    return F.regexp_replace(F.regexp_replace(col(text), SECRET_PREFIX, "<redacted>"), f"(?i){SECRET_ASSIGNMENT}", "$1=<redacted>")


def unquote(name: Column | str) -> Column:
    """Without one pair of matching quotes."""
    return F.regexp_replace(col(name), r"^(['\"`])(.*)\1$", "$2")


def byte_offset(text: Column | str, offset: Column | str) -> Column:
    """UTF-8 byte offset of a code-point offset."""
    return F.octet_length(F.substring(col(text), F.lit(1), col(offset).cast("int")))


def canonical_json(fields: list[Column]) -> Column:
    """JSON with keys in alphabetical order (give the fields so) and nulls kept."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def sha256_hex(text: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(col(text), 256))
