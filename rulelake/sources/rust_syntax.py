"""Items of Rust sources by a scanner of tokens: comments, strings and nested brackets are understood, macros are not expanded."""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<line>//[^\n]*)|(?P<block>/\*)|(?P<raw>b?c?r(?P<marks>\#*)")|(?P<text>[bc]?"(?:[^"\\]|\\.)*")|(?P<char>b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.))')"""
    r"""|(?P<life>'[A-Za-z_]\w*)|(?P<word>r\#[A-Za-z_]\w*|[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<sign>.)""",
    re.DOTALL,
)
_OPEN, _SHUT = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
#: Items that end with a semicolon, and those that end with it or with a block.
_PLAIN = {"use": "use", "type": "type", "static": "static", "const": "const"}
_BLOCKS = {"fn": "fn", "mod": "mod", "struct": "struct", "enum": "enum", "impl": "impl", "trait": "trait"}
_BEFORE = {"async", "unsafe", "default", "auto", "safe"}


@dataclass(frozen=True)
class Item:
    """A top-level item: what it is, its name where it has one, whether it is public, and its lines."""

    kind: str
    name: str
    public: bool
    start_line: int
    end_line: int


class RustError(ValueError):
    """A source whose brackets or comments don't close."""


def tokens(source: str) -> list[tuple[str, str, int]]:
    """(kind, text, line) of a source, without spaces and comments."""
    out, at, line = [], 0, 1
    while at < len(source):
        match = _TOKEN.match(source, at)
        kind, end = match.lastgroup if match.lastgroup != "marks" else "raw", match.end()
        if kind == "block":
            depth = 1
            while depth:
                mark = re.compile(r"/\*|\*/").search(source, end)
                if mark is None:
                    raise RustError("a comment does not end")
                depth, end = depth + (1 if mark[0] == "/*" else -1), mark.end()
        elif kind == "raw":
            close = source.find('"' + match["marks"], end)
            if close < 0:
                raise RustError("a string does not end")
            end = close + 1 + len(match["marks"])
        if kind not in ("space", "line", "block"):
            out.append((kind, source[at:end], line))
        line += source.count("\n", at, end)
        at = end
    return out


def _closing(toks: list[tuple[str, str, int]], at: int) -> int:
    """The place of the bracket that closes the one at ``at``."""
    stack = []
    for k in range(at, len(toks)):
        kind, text, _ = toks[k]
        if kind == "sign" and text in _OPEN:
            stack.append(_OPEN[text])
        elif kind == "sign" and text in _SHUT:
            if not stack or stack.pop() != text:
                raise RustError("brackets do not match")
            if not stack:
                return k
    raise RustError("a bracket does not close")


def items(source: str) -> list[Item]:
    """The top-level items of a source, in order."""
    toks, out, at = tokens(source), [], 0
    text = lambda k: toks[k][1] if k < len(toks) else ""
    while at < len(toks):
        start, public = at, False
        while text(at) == "#":  # attributes
            at = _closing(toks, at + 1 + (text(at + 1) == "!")) + 1
        if at >= len(toks):
            break
        first = at
        if text(at) == "pub":
            public, at = True, at + 1
            if text(at) == "(":
                at = _closing(toks, at) + 1
        while text(at) in _BEFORE or (text(at) == "const" and text(at + 1) in _BEFORE | {"fn", "extern"}) or (text(at) == "extern" and text(at + 1) != "crate" and (text(at + 2) == "fn" or text(at + 1) == "fn")):
            at += 2 if text(at) == "extern" and text(at + 1) != "fn" else 1
        word, name = text(at), text(at + 1)
        if word == "extern":
            kind, name = ("extern_crate", text(at + 2)) if name == "crate" else ("foreign_mod", "")
        elif word == "union" and toks[at + 1][0] == "word" and text(at + 2) in ("{", "<", "where"):
            kind = "union"
        elif word in _PLAIN or word in _BLOCKS:
            kind = _PLAIN.get(word) or _BLOCKS[word]
            name = text(at + 2) if word == "static" and name == "mut" else name
        elif word == "macro_rules" and name == "!":
            kind, name = "macro", text(at + 2)
        elif toks[at][0] == "word" and "!" in (name, text(at + 3)) or word == "macro":
            kind, name = ("other", name) if word == "macro" else ("macro", word)
        else:
            at = max(at, first) + 1  # no item begins here
            continue
        end, braces = at, kind not in ("use", "type", "static", "const", "extern_crate")
        while end < len(toks) and text(end) != ";":
            if text(end) in _OPEN and toks[end][0] == "sign":
                shut = _closing(toks, end)
                if text(end) == "{" and braces:
                    end = shut
                    break
                end = shut
            if kind == "trait" and text(end) == "=":
                kind, braces = "trait_alias", False
            end += 1
        end = min(end, len(toks) - 1)
        out.append(Item(kind, name if toks and re.match(r"\w", name or "") and kind not in ("impl", "foreign_mod") else "", public, toks[start][2], toks[end][2]))
        at = end + 1
    return out


def summary(source: str) -> str | None:
    """The counts of a source's top-level items by kind, as compact JSON in order of keys; null where it can't be read."""
    try:
        counts = Counter(item.kind for item in items(source))
    except (RustError, IndexError):
        return None
    return json.dumps({"counts": dict(sorted(counts.items())), "summary_type": "rust_ast_item_counts"}, separators=(",", ":"))


def summaries(texts: DataFrame) -> DataFrame:
    """(path, ast_summary) of (path, text) rows, in Arrow batches."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([summary(t or "") for t in batch.column(1).to_pylist()], pa.string())], ["path", "ast_summary"])

    return texts.select("path", "text").mapInArrow(run, f"path {texts.schema['path'].dataType.simpleString()}, ast_summary string")


def structure(texts: DataFrame) -> DataFrame:
    """(path, kind, name, public, start_line, end_line) of the top-level items of (path, text) rows."""
    names = ["path", "kind", "name", "public", "start_line", "end_line"]
    types = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32()]

    def run(batches):
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(path, i.kind, i.name, i.public, i.start_line, i.end_line) for i in items(text or "")]
                except (RustError, IndexError):
                    rows.append((path, "unreadable", "", False, 1, 1))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return texts.select("path", "text").mapInArrow(run, "path string, kind string, name string, public boolean, start_line int, end_line int")
