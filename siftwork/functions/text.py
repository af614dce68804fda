"""Column expressions on text and paths; all run in the JVM."""

from __future__ import annotations

import re

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
QUESTION_STARTERS = ["what", "who", "where", "when", "why", "how", "which", "is", "are", "does", "do", "did", "can", "could", "should", "would", "will"]
PROSE_EXTENSIONS = ["md", "txt", "rst", "org", "adoc"]
CODE_KINDS = ["function", "impl", "class", "interface", "type", "enum", "struct", "module"]
FILE_KIND = "file"
TRUNCATED = "\n… [truncated, %s more chars — read the file directly for the rest]"
# End of fixed values.

#: Characters that a word is cut at: anything that is not alphanumeric.
NOT_WORD = r"[^\p{IsAlphabetic}\p{N}]+"
_BLANK = r"\A\s+|\s+\z"


def is_blank(c: Column) -> Column:
    """No character but blanks; null stays null."""
    return F.length(F.regexp_replace(c, r"(?U)\s", "")) == 0


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)" + _BLANK, "")


def is_question(q: Column) -> Column:
    t = F.lower(trimmed(q))
    return F.coalesce((t != "") & (t.endswith("?") | t.rlike(r"\A(" + "|".join(QUESTION_STARTERS) + r")( |\z)")), F.lit(False))


def looks_like_identifier(q: Column) -> Column:
    return F.coalesce(q.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*\z"), F.lit(False))


def query_terms(q: Column) -> Column:
    """Sorted distinct lower-case words of at least three bytes."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(q), NOT_WORD), lambda t: F.octet_length(t) >= 3)))


def term_hash(term: Column) -> Column:
    return F.xxhash64(term)


def stored_terms(content: Column) -> Column:
    """The hashes of query_terms(content), sorted, as they are stored beside a content."""
    # Numbers, not words, are made distinct and sorted, and by sort_array: array_sort compares by a lambda.
    words = F.filter(F.split(F.lower(content), NOT_WORD), lambda t: F.octet_length(t) >= 3)
    return F.sort_array(F.array_distinct(F.transform(words, term_hash)))


def content_match(terms: Column, content: Column) -> Column:
    """Share of the terms that are whole words of the content; 0 without terms."""
    words = F.split(F.lower(content), NOT_WORD)
    n = F.size(terms)
    return F.when(n > 0, F.size(F.array_intersect(terms, words)) / n).otherwise(F.lit(0.0))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Suffix of the file name without its dot; "" where there is none, as for dot files."""
    return F.regexp_extract(file_name(path), r"(?s)\A.+\.([^.]*)\z", 1)


def dir_name(path: Column) -> Column:
    plain = F.regexp_replace(path, r"/\z", "")
    return F.regexp_replace(plain, r"(?s)/?[^/]*\z", "")


def base_name(path: Column) -> Column:
    return file_name(F.regexp_replace(path, r"/\z", ""))


def is_prose_file(path: Column) -> Column:
    return F.lower(extension(path)).isin(PROSE_EXTENSIONS)


def is_code_chunk(kind: Column) -> Column:
    return kind != FILE_KIND


def under(path: Column, folder: str) -> Column:
    return path.startswith(folder.rstrip("/") + "/")


def line_of(content: Column, needle: Column) -> Column:
    """Line, from 1, of the first occurrence; 1 without any."""
    at = F.instr(content, needle)
    before = F.substr(content, F.lit(1), F.greatest(at - 1, F.lit(0)))
    return F.when(at > 0, F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).otherwise(F.lit(1))


def result_line(kind: Column, start: Column, best: Column) -> Column:
    """Line to open for a result: where its chunk starts, or in a whole file its best line; 1 if there is none."""
    return F.when(is_code_chunk(kind), start).otherwise(F.coalesce(best, F.lit(1)))


def line_sentences(line: Column) -> Column:
    """Pieces of a line, cut after . ! or ? at its end or before a space."""
    cut = F.split(F.regexp_replace(line, r"([.!?])( |\z)", "$1\u0001"), "\u0001")
    return F.transform(cut, lambda s: trimmed(s))


def sentences(content: Column) -> Column:
    """Sentences of more than three bytes that are no headings, in order."""
    every = F.flatten(F.transform(F.split(content, "\n"), line_sentences))
    return F.filter(every, lambda s: (F.octet_length(s) > 3) & ~s.startswith("#"))


def truncate_content(content: Column, most: int) -> Column:
    head, tail = TRUNCATED.split("%s")
    return F.when(F.length(content) > most, F.concat(F.left(content, F.lit(most)), F.lit(head), (F.length(content) - most).cast("string"), F.lit(tail))).otherwise(content)


def line_range(content: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1, inclusive), clamped to what is there."""
    plain = F.regexp_replace(content, r"\r?\n\z", "")
    lines = F.when(content == "", F.array().cast("array<string>")).otherwise(F.split(plain, r"\r?\n"))
    first = F.least(F.greatest(start - 1, F.lit(0)), F.size(lines))
    last = F.greatest(F.least(end, F.size(lines)), first)
    return F.array_join(F.slice(lines, first + 1, last - first), "\n")


def context_block(path: Column, start: Column, end: Column, kind: Column, score: Column, content: Column) -> Column:
    return F.concat(F.format_string("%s:%d-%d (%s, score %.2f)", path, start, end, kind, score), F.lit("\n"), content)


def question(q: str) -> bool:
    """is_question for one query on the driver."""
    t = q.strip().lower()
    return bool(t) and (t.endswith("?") or t.split(" ", 1)[0] in QUESTION_STARTERS)


def identifier(q: str) -> bool:
    return re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", q) is not None


def terms(q: str) -> list[str]:
    """query_terms for one query on the driver."""
    words = regex.split(r"[^\p{Alphabetic}\p{N}]+", q.lower())
    return sorted({w for w in words if len(w.encode()) >= 3})
