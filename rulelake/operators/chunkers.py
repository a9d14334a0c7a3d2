"""Chunks of files by format: markdown and text within Spark, source code and notebooks in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CHARS, OVERLAP_CHARS = 2400, 160
LANGUAGES = {"md": "markdown", "rs": "rust", "py": "python", "txt": "text", "ipynb": "python"}
CHUNK = "path string, format string, language string, kind string, heading_path array<string>, start_line int, end_line int, start_byte long, end_byte long, text string"

_RUST_ITEM = re.compile(r"\s*(pub(\([^)]*\))?\s+)?((async|const|unsafe|extern)\s+)*((fn|struct|enum|trait|impl|mod|type|static|use)\b|macro_rules!|#\[)")
_PY_BLOCK = re.compile(r"(async\s+def|def|class)\s")


def _lines(text: str) -> list[str]:
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def _pieces(lines: list[str], starts: list[int]) -> Iterator[tuple[int, int]]:
    yield from zip(starts, [*starts[1:], len(lines)], strict=True)


def _windows(count: int, window: int, overlap: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < count:
        end = min(at + window, count)
        yield at, end
        if end == count:
            return
        at += max(1, window - overlap)


def heading(line: str) -> tuple[int, str] | None:
    """Level and title of a heading line."""
    match = re.match(r"\s*(#+)(.*)$", line, re.DOTALL)
    if match is None or len(match[1]) > 6 or not match[2].strip():
        return None
    return len(match[1]), match[2].strip().rstrip("#").strip()


def spans(fmt: str, text: str) -> Iterator[tuple[str, list[str], int, int]]:
    """(kind, heading path, first line, end line) of a text by format; lines count from 0."""
    lines = _lines(text)
    if fmt == "md":
        stack: list[tuple[int, str]] = []
        path, start = [], 0
        for k, line in enumerate(lines):
            if found := heading(line.rstrip("\r\n")):
                yield "markdown_section", path, start, k
                stack = [h for h in stack if h[0] < found[0]] + [found]
                path, start = [title for _, title in stack], k
        yield "markdown_section", path, start, len(lines)
    elif fmt == "txt":
        start = 0
        for k, line in enumerate(lines):
            if not line.strip():
                yield "text_paragraph", [], start, k
                start = k + 1
        yield "text_paragraph", [], start, len(lines)
    elif fmt == "py":
        starts = [0] + [k for k, line in enumerate(lines) if k and _PY_BLOCK.match(line)]
        if len(starts) > 1:
            yield from (("python_block", [], a, b) for a, b in _pieces(lines, starts))
        else:
            yield from (("python_fallback_window", [], a, b) for a, b in _windows(len(lines), 100, 20))
    elif fmt == "rs":
        starts, depth = [0], 0
        for k, line in enumerate(lines):
            if k and depth == 0 and _RUST_ITEM.match(line):
                starts.append(k)
            depth += line.count("{") - line.count("}")
        if len(starts) > 1:
            yield from (("rust_item", [], a, b) for a, b in _pieces(lines, starts))
        else:
            yield from (("rust_fallback_window", [], a, b) for a, b in _windows(len(lines), 120, 24))


def chunk_text(path: str, fmt: str, text: str) -> list[tuple]:
    """Chunk rows of a file: by its format, else in windows of lines; long chunks are split by characters."""
    rows = []
    if fmt == "ipynb":
        rows = _notebook(path, text)
    else:
        rows = _placed(path, fmt, LANGUAGES.get(fmt), text, spans(fmt, text))
    if not rows and text.strip():
        fallback = (("fallback_window", [], a, b) for a, b in _windows(len(_lines(text)), 120, 24))
        rows = _placed(path, fmt, LANGUAGES.get(fmt), text, fallback)
    return [part for row in rows for part in split_by_size(row)]


def _placed(path, fmt, language, text, found) -> list[tuple]:
    lines, offsets = _lines(text), [0]
    for line in lines:
        offsets.append(offsets[-1] + len(line.encode()))
    out = []
    for kind, heads, a, b in found:
        body = "".join(lines[a:b])
        if a < b and body.strip():
            out.append((path, fmt, language, kind, heads, a + 1, b, offsets[a], offsets[b], body))
    return out


def _notebook(path: str, text: str) -> list[tuple]:
    out = []
    for number, cell in enumerate(json.loads(text)["cells"]):
        source = cell.get("source", "")
        source = source if isinstance(source, str) else "".join(s for s in source if isinstance(s, str))
        if not source.strip():
            continue
        kind = cell.get("cell_type", "unknown")
        if kind == "markdown":
            made = [(p, f, "markdown", "ipynb_markdown_cell", [f"Cell {number + 1}", *h], *rest) for p, f, _, _, h, *rest in _placed(path, "ipynb", None, source, spans("md", source))]
        elif kind == "code":
            found = [(k.replace("python_block", "ipynb_code_cell"), h, a, b) for k, h, a, b in spans("py", source)]
            made = _placed(path, "ipynb", "python", source, found)
        else:
            made = _placed(path, "ipynb", "text", source, (("ipynb_text_cell", h, a, b) for _, h, a, b in spans("txt", source)))
        out += made
    return out


def split_by_size(row: tuple, most: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> list[tuple]:
    """A chunk as overlapping parts of bounded length, each with its place."""
    *head, start_line, end_line, start_byte, end_byte, text = row
    if len(text) <= most:
        return [row]
    out = []
    for a, b in _windows(len(text), most, overlap):
        before, part = text[:a], text[a:b]
        line = start_line + before.count("\n")
        out.append((*head, line, line + part.count("\n"), start_byte + len(before.encode()), start_byte + len(text[:b].encode()), part))
    return out


def chunk_files(texts: DataFrame) -> DataFrame:
    """Chunks of (path, text) rows by the extension of the path; a notebook that does not parse gives line windows."""
    names = [part.split()[0] for part in CHUNK.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fmt = path.rsplit(".", 1)[-1].lower() if "." in path else "txt"
                try:
                    rows += chunk_text(path, fmt, text or "")
                except (ValueError, KeyError, AttributeError, TypeError):
                    rows += chunk_text(path, "text", text or "")
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return texts.select("path", F.col("text")).mapInArrow(run, CHUNK)


def format_of(path: Column) -> Column:
    """The format of a file by its extension, in lower case; text without one."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    return F.when(extension != "", extension).otherwise("txt")


def language_of(path: Column) -> Column:
    """The language of a file by its extension, or null."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), format_of(path))


def _mapped(texts: DataFrame, run, schema: str, types: list[pa.DataType]) -> DataFrame:
    """Rows that ``run(text)`` gives for (path, text) rows, in Arrow batches."""
    kind = texts.schema["path"].dataType.simpleString()
    names = ["path", *[part.split()[0] for part in schema.split(", ")]]

    def work(batches):
        for batch in batches:
            rows = [(path, *row) for path, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True) for row in run(text or "")]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            paths = pa.array([p.as_py() for p in columns[0]], batch.schema.field(0).type)
            yield pa.RecordBatch.from_arrays([paths, *[pa.array(c, t) for c, t in zip(columns[1:], types, strict=True)]], names)

    return texts.select("path", "text").mapInArrow(work, f"path {kind}, {schema}")


def normative_rows(texts: DataFrame) -> DataFrame:
    """(path, place, line) of the lines of (path, text) rows that say what must or must not be."""
    return _mapped(texts, lambda text: list(enumerate(normative_lines(text))), "place int, line string", [pa.int32(), pa.string()])


def described(texts: DataFrame, title: str) -> DataFrame:
    """(path, summary, section) of (path, text) rows: the first paragraph, and the body of the section of a title."""
    return _mapped(texts, lambda text: [(summary(text), section(text, title))], "summary string, section string", [pa.string(), pa.string()])


def demoted(texts: DataFrame, levels: int) -> DataFrame:
    """The (path, text) rows with their headings moved down."""
    return _mapped(texts, lambda text: [(demote_headings(text, levels),)], "text string", [pa.string()])


def normative_lines(markdown: str) -> list[str]:
    """Lines that say what must or must not be, without list marks."""
    out = []
    for line in markdown.splitlines():
        body = re.sub(r"^\s*(?:[-*+]|\d+\.)\s+", "", line).strip()
        if re.search(r"\b(must|shall|never|always|required|forbidden)\b", body, re.IGNORECASE) and not body.startswith("#"):
            out.append(body)
    return out


def summary(markdown: str) -> str | None:
    """The first paragraph that is no heading."""
    for part in re.split(r"\n\s*\n", markdown):
        lines = [line.strip() for line in part.splitlines() if line.strip() and not line.lstrip().startswith(("#", "---"))]
        if lines:
            return " ".join(lines)
    return None


def section(markdown: str, title: str) -> str | None:
    """The body of a second-level section, up to the next heading of that level or above."""
    out, inside = [], False
    for line in markdown.splitlines():
        found = heading(line)
        if found and found[0] <= 2:
            if inside:
                break
            inside = found[0] == 2 and found[1].lower() == title.lower()
            continue
        if inside:
            out.append(line)
    return "\n".join(out).strip() if inside or out else None


def demote_headings(markdown: str, levels: int) -> str:
    """Headings moved down, outside code fences, to the sixth level at most."""
    out, fenced = [], False
    for line in markdown.split("\n"):
        fenced ^= line.lstrip().startswith("```")
        match = re.match(r"(#{1,6})(\s.*)$", line)
        out.append("#" * min(6, len(match[1]) + levels) + match[2] if match and not fenced else line)
    return "\n".join(out)


def link_to_anchors(markdown: str, anchors: dict[str, str]) -> str:
    """Wiki links to known names as links within one book, others as their text."""

    def replace(match: re.Match) -> str:
        target, _, alias = match[1].partition("|")
        name = target.partition("#")[0].strip()
        said = alias.strip() or name
        return f"[{said}](#{anchors[name.lower()]})" if name.lower() in anchors else said

    return re.sub(r"!?\[\[([^\]]+)\]\]", replace, markdown)


def concept_book(notes: dict[str, str], dependencies: list[tuple[str, str]], seeds: list[str], order) -> str:
    """The seeds and all that they depend on, dependencies first, as one text; ``order(edges, nodes)`` sorts."""
    needed, front = set(), list(seeds)
    while front:
        name = front.pop()
        if name not in needed:
            needed.add(name)
            front += [a for a, b in dependencies if b == name]
    names = order([(a, b) for a, b in dependencies if a in needed and b in needed], sorted(needed))
    anchors = {n.lower(): re.sub(r"[^a-z0-9]+", "-", n.lower()).strip("-") for n in names}
    return "\n\n".join(f"# {n}\n\n{link_to_anchors(demote_headings(notes.get(n, ''), 1), anchors)}".rstrip() for n in names) + "\n"
