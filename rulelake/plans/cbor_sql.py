"""DuckDB expressions for the hexadecimal canonical CBOR of records, written apart from the columns that they check."""

from __future__ import annotations


def head(kind: int, n: str) -> str:
    base = kind * 32
    return (
        f"(CASE WHEN {n} < 24 THEN printf('%02x', CAST({base} + {n} AS BIGINT)) WHEN {n} < 256 THEN printf('%02x%02x', {base + 24}, CAST({n} AS BIGINT)) "
        f"WHEN {n} < 65536 THEN printf('%02x%04x', {base + 25}, CAST({n} AS BIGINT)) ELSE printf('%02x%08x', {base + 26}, CAST({n} AS BIGINT)) END)"
    )


def integer(n: str) -> str:
    return f"(CASE WHEN {n} IS NULL THEN 'f6' WHEN {n} >= 0 THEN {head(0, n)} ELSE {head(1, f'(-1 - {n})')} END)"


def text(t: str) -> str:
    return f"(CASE WHEN {t} IS NULL THEN 'f6' ELSE {head(3, f'strlen({t})')} || lower(hex(encode({t}))) END)"


def key(name: str) -> str:
    raw = name.encode()
    return ((bytes([0x60 + len(raw)]) if len(raw) < 24 else bytes([0x78, len(raw)])) + raw).hex()


def mapping(entries: dict[str, str]) -> str:
    """Entries in their canonical order: shorter keys first, equals by their bytes."""
    ordered = sorted(entries, key=lambda k: (len(k.encode()), k.encode()))
    return "(" + " || ".join([f"'{0xA0 + len(entries):02x}'"] + [f"'{key(k)}' || {entries[k]}" for k in ordered]) + ")"


def sha256(hexadecimal: str) -> str:
    return f"sha256(unhex({hexadecimal}))"
