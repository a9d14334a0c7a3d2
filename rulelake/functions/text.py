"""Column builders for text, paths and digests."""

from __future__ import annotations

import re
import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def lines(text: Column) -> Column:
    """Lines of a text: a last line end starts no further line, and a carriage return before a line end is dropped."""
    split = F.split(F.regexp_replace(text, r"\n\z", ""), "\n")
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(F.transform(split, lambda line: F.regexp_replace(line, r"\r\z", "")))


def lines_with_ends(text: Column) -> Column:
    """Lines that keep their line ends; joined they are the text."""
    pieces = F.split(text, "(?<=\n)")
    return F.filter(pieces, lambda p: p != "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def line_metrics(text: Column, marker: str) -> Column:
    """A struct of size in bytes, lines, lines with ink, longest line in characters, and lines that hold the marker; the text is
    cut into lines once."""
    metrics = lambda rows: {
        "bytes": F.coalesce(F.octet_length(text), F.lit(0)),
        "lines": F.size(rows),
        "nonempty_lines": F.size(F.filter(rows, lambda r: r.rlike(r"\S"))),
        "max_line_len": F.coalesce(F.array_max(F.transform(rows, lambda r: F.length(r))), F.lit(0)),
        "marker_lines": F.size(F.filter(rows, lambda r: F.contains(r, F.lit(marker)))),
    }
    return let(lines(text), lambda rows: F.struct(*[c.cast("long").alias(n) for n, c in metrics(rows).items()]))


def collapse_space(text: Column) -> Column:
    """Words of a text joined by single spaces."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def simple_tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores, and every other sign by itself."""
    return F.regexp_extract_all(text, F.lit(r"([\p{IsAlphabetic}\p{N}_]+|[^\p{IsWhite_Space}\p{IsAlphabetic}\p{N}_])"), F.lit(1))


def sha(*parts: Column) -> Column:
    """SHA-256 of parts joined by a bar."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def run_scoped_id(base: Column, run: Column) -> Column:
    """An id that is of its own in each run, and the base where there is no run."""
    return F.when(run.isNull(), base).otherwise(F.sha2(F.concat(run, F.lit("|"), base), 256))


def glob_regex(pattern: str) -> str:
    """An anchored expression for a glob in which ``*`` crosses slashes and ``?`` is one character."""
    return "(?s)^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def glob_regex_column(pattern: Column) -> Column:
    """The same for a column of patterns."""
    quoted = F.regexp_replace(pattern, r"([\\\.\[\]\{\}\(\)\+\^\$\|])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def ignored_by(pattern: str, path: str, name: str, is_dir: bool) -> bool:
    """Whether an ignore pattern takes a path: a trailing slash means folders only, a slash elsewhere anchors it."""
    pattern = pattern.strip()
    if not pattern or pattern[0] in "#!":
        return False
    if pattern.endswith("/"):
        if not is_dir:
            return False
        pattern = pattern[:-1]
    anchored = pattern.startswith("/")
    pattern = pattern.removeprefix("/")
    return bool(re.match(glob_regex(pattern), path if anchored or "/" in pattern else name))


def normalize_target(target: Column) -> Column:
    """A link target without outer space, with slashes, and without leading ``./`` and ``/``."""
    return F.regexp_replace(F.regexp_replace(F.replace(F.trim(target), F.lit("\\"), F.lit("/")), r"^(\./)+", ""), r"^/+", "")


def asset_like(target: Column) -> Column:
    """Whether a link target looks like a file that is no note: its last part has an extension other than ``.md``."""
    path = normalize_target(target)
    return (path != "") & ~F.endswith(F.lower(path), F.lit(".md")) & F.contains(F.regexp_extract(path, r"([^/]*)$", 1), F.lit("."))


def normalize_heading(heading: Column) -> Column:
    """A heading with single spaces and ASCII lower case."""
    return ascii_lower(collapse_space(heading))


def heading_slug(heading: Column) -> Column:
    """A heading as an anchor: ASCII letters and digits, runs of space and hyphens as one hyphen."""
    kept = F.regexp_replace(ascii_lower(F.trim(heading)), r"[^a-z0-9\s-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"[\s-]+", "-"), r"-+$", "")


def file_stem(path: Column) -> Column:
    """The last part of a path without its last extension."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(name.rlike(r"^\.[^.]*$"), name).otherwise(F.regexp_replace(name, r"(.)\.[^.]*$", "$1"))


def parent_dir(path: Column) -> Column:
    """What stands before the last slash, or nothing."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def normalize_path(path: Column) -> Column:
    """A relative path with slashes and without a leading ``./``."""
    return F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def normalize_invariant(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"\s", "_")


def heading_level(line: Column) -> Column:
    """1 to 6 for a heading line with a title, else null; no space is needed after the signs."""
    signs = F.length(F.regexp_extract(line, r"^\s*(#*)", 1))
    titled = F.regexp_extract(line, r"^\s*#*(.*)$", 1).rlike(r"\S")
    return F.when((signs >= 1) & (signs <= 6) & titled, signs)


def heading_title(line: Column) -> Column:
    """A heading's title without closing signs."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(line, r"^\s*#+", "")), "#+$", ""))


def observed(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Occurrences of a pattern, overlapping ones too. A pattern is words divided by ``|``; ``\\b`` around one asks for
    ASCII word bounds."""
    return F.regexp_count(ascii_lower(text) if ignore_case else text, F.lit(f"(?={_observed_needle(pattern, ignore_case)})")).cast("long")


def _observed_needle(pattern: str, ignore_case: bool) -> str:
    alternatives = []
    for part in pattern.split("|"):
        bounded = part.startswith(r"\b") and part.endswith(r"\b") and len(part) > 4
        body = re.escape(part[2:-2] if bounded else part)
        alternatives.append(rf"(?<![A-Za-z0-9_]){body}(?![A-Za-z0-9_])" if bounded else body)
    needle = "|".join(alternatives)
    if ignore_case:
        needle = needle.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)).replace(r"(?<![a-za-z0-9_])", r"(?<![a-z0-9_])").replace(r"(?![a-za-z0-9_])", r"(?![a-z0-9_])")
    return needle


def observed_places(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Where a pattern occurs, overlapping places too: (line, col) from 1 on, columns counted in characters. A pattern is
    that of ``observed``."""
    needle, haystack = _observed_needle(pattern, ignore_case), ascii_lower(text) if ignore_case else text

    def in_line(row: Column, number: Column) -> Column:
        # cut before each occurrence: all pieces begin with one, but for the first where it does not
        pieces = F.split(row, f"(?={needle})")
        starts = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), F.array(F.lit(1)), lambda made, piece: F.concat(made, F.array(F.element_at(made, -1) + F.length(piece))))
        hits = F.when(row.rlike(f"^(?={needle})"), starts).otherwise(F.slice(starts, 2, F.size(starts)))
        return F.transform(hits, lambda c: F.struct((number + 1).cast("int").alias("line"), c.cast("int").alias("col")))

    return F.flatten(F.transform(lines(haystack), in_line))


def term_count(text: Column, term: Column) -> Column:
    """Occurrences of a term between spaces or the ends of a text."""
    pattern = F.concat(F.lit(r"(?<![^ ])\Q"), term, F.lit(r"\E(?![^ ])"))
    return F.when(F.length(term) == 0, F.lit(0)).otherwise(F.regexp_count(text, pattern)).cast("long")


def mention_text(markdown: Column) -> Column:
    """Plain lower-case text for term search: no code, comments, wiki links or link addresses, single spaces."""
    text = F.regexp_replace(markdown, r"(?s)```.*?```", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"\[\[.*?\]\]", " ")
    text = F.regexp_replace(text, r"`[^`]*`", " ")
    text = F.regexp_replace(text, r"\]\([^)]*\)", " ")
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def truncate_vector(vector: Column, size: int) -> Column:
    return F.slice(vector, 1, size)


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 2).when(severity == "warning", 1).otherwise(0)


def check_state(status: Column, conclusion: Column) -> Column:
    """A check is green on success, red when completed otherwise, and else pending."""
    return F.when(conclusion == "SUCCESS", "green").when(ascii_lower(status) == "completed", "red").otherwise("pending")


def retry_delay_ms(attempt: Column, first: int = 100, factor: float = 2.0, most: int = 5000) -> Column:
    """Exponential backoff, bounded."""
    delay = F.least(F.lit(float(most)), F.lit(float(first)) * F.pow(F.lit(factor), attempt - 1))
    return F.when(attempt == 0, F.lit(0)).otherwise(delay).cast("long")
