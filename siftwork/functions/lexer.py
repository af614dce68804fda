"""Tokens of source files: words, strings, punctuation and line ends; comments and preprocessor lines are left out.

A language is a set of modes: nested comments, raw strings, strings with code inside, template and regex
literals, heredocs. Strings are one token, whatever they hold, so braces and keywords within them do not count.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    text: str  # a string is '"'; a line end is "\n"
    start: int
    end: int


_PLAIN = re.compile(r"(?P<blank>[^\S\n]+)|(?P<line>\n)|(?P<word>[^\W\d][\w]*|\d\w*)|(?P<two>=>|->|::|&\.|[-+*/%&|^<=!>]=(?!=)|==|&&|\|\|)|(?P<one>.)", re.S)
_JS_WORD = re.compile(r"[$#]?[\w$]+")
#: A slash after these begins a regex literal.
_BEFORE_REGEX = set("(,=:[!&|?{};+-*/%~^<>\n") | {"=>", "&&", "||", "==", "return", "typeof", "case", "in", "of", "do", "else", "new", "delete", "void", "throw", "await", "yield", "and", "or", "not", "if", "unless", "when", "while", "until", "+=", "-=", "*=", "!=", "<=", ">="}
_REGEX = re.compile(r"/(?![*/\n])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
_PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}
_HEREDOC = re.compile(r"<<(?:[~-](?P<q>[\"'`]?)(?P<a>\w+)(?P=q)|(?P<p>[\"'`]?)(?P<b>[A-Z_]\w*)(?P=p))")
_PERCENT = re.compile(r"%[wWiIqQrsx]?(?=[(\[{<|!/])")
_DIRECTIVE = re.compile(r"[ \t]*#[ \t]*(\w*)((?:[^\n\\]|\\.)*)", re.S)


def _quoted(source: str, at: int, quote: str, lines: bool = False) -> int:
    """Past a string that opens at `at`; 0 where it does not close (on its line, unless it may go over lines)."""
    i = at + len(quote)
    while i < len(source):
        c = source[i]
        if c == "\\":
            i += 2
        elif source.startswith(quote, i):
            return i + len(quote)
        elif c == "\n" and not lines:
            return 0
        else:
            i += 1
    return 0


def _nested(source: str, at: int) -> int:
    """Past a comment that may hold others."""
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(source, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(source)


def _with_code(source: str, at: int, quote: str, opener: str, closer: str, language: str, lines: bool) -> int:
    """Past a string in which `opener` begins code, up to its `closer`; 0 where it does not close."""
    i = at + len(quote)
    while i < len(source):
        if source.startswith(opener, i):
            depth, last = 0, i
            for t in tokens(source, language, i + len(opener) - 1):
                depth += (t.text == opener[-1]) - (t.text == closer)
                last = t.end
                if not depth:
                    break
            i = last
        elif source[i] == "\\":
            i += 2
        elif source.startswith(quote, i):
            return i + len(quote)
        elif source[i] == "\n" and not lines:
            return 0
        else:
            i += 1
    return 0


def _delimited(source: str, at: int) -> int:
    """Past a literal whose delimiters nest, if they are brackets."""
    opener = source[at]
    closer, depth, i = _PAIRS.get(opener, opener), 0, at
    while i < len(source):
        if source[i] == "\\":
            i += 1
        elif source[i] == closer and (closer != opener or i > at):
            depth -= 1
            if depth <= 0:
                return i + 1
        elif source[i] == opener:
            depth += 1
        i += 1
    return len(source)


def _heredocs(source: str, at: int, names: list[str]) -> int:
    """Past the bodies of heredocs that begin on the line at `at`."""
    for name in names:
        m = re.compile(rf"^[ \t]*{re.escape(name)}[ \t]*$", re.M).search(source, at)
        at = m.end() if m else len(source)
    return at


def _directive(source: str, at: int) -> int:
    """Past a preprocessor line; also past other branches of a condition, of which the first counts (or #if 0's second)."""
    m = _DIRECTIVE.match(source, at)
    skip = m[1] in ("else", "elif") or (m[1] == "if" and m[2].strip() == "0")
    end, depth = m.end(), 0
    while skip and end < len(source):
        line = source.find("\n", end) + 1
        if not line:
            return len(source)
        m = _DIRECTIVE.match(source, line)
        end = m.end() if m else line
        if m and m[1] in ("if", "ifdef", "ifndef"):
            depth += 1
        elif m and m[1] == "endif":
            depth -= 1
            skip = depth >= 0
        elif m and m[1] in ("else", "elif") and not depth:
            skip = m[1] == "elif"
    return end


def _literal(source: str, at: int, c: str, language: str, before: str) -> int:
    """Past the comment or literal at `at`, negative for a comment; 0 if there is none."""
    three = source.startswith('"""', at)
    if language == "ruby":
        if c == "#":
            end = source.find("\n", at)
            return -(end if end >= 0 else len(source))
        if c == "=" and source.startswith("=begin", at) and (at == 0 or source[at - 1] == "\n"):
            m = re.compile(r"^=end.*$", re.M).search(source, at)
            return -(m.end() if m else len(source))
        if c in "\"`":
            return _with_code(source, at, c, "#{", "}", language, True)
        if c == "'":
            return _quoted(source, at, c, True)
        if c == ":" and source[at + 1 : at + 2] in ('"', "'") and before != ":":
            return _quoted(source, at + 1, source[at + 1], True)
        if c == "/" and before in _BEFORE_REGEX and (m := _REGEX.match(source, at)):
            return m.end()
        if c == "%" and before in _BEFORE_REGEX | {"\n", "puts"} and (m := _PERCENT.match(source, at)):
            return _delimited(source, m.end())
        if c == "?" and re.match(r"\?\\?[^\s\w]|\?\w\b", source[at : at + 4]) and before in _BEFORE_REGEX:
            return at + 2
        return 0
    if c == "/" and source.startswith("//", at):
        end = source.find("\n", at)
        return -(end if end >= 0 else len(source))
    if c == "/" and source.startswith("/*", at):
        if language in ("rust", "swift"):
            return -_nested(source, at)
        end = source.find("*/", at + 2)
        return -(end + 2 if end >= 0 else len(source))
    if language in ("js", "ts"):
        if c == "/" and before in _BEFORE_REGEX and (m := _REGEX.match(source, at)):
            return m.end()
        if c == "`":
            return _with_code(source, at, c, "${", "}", language, True)
    elif language == "go" and c == "`":
        return (source.find("`", at + 1) + 1) or len(source)
    elif language == "rust":
        if c in "rb" and not before.endswith("'") and (m := re.compile(r'b?r(#*)"').match(source, at)):
            return (source.find('"' + m[1], m.end()) + 1 + len(m[1])) or len(source)
        if c == "'":
            m = re.compile(r"'(?:\\(?:u\{\w+\}|x\w\w|.)|[^\\'\n])'").match(source, at)
            return m.end() if m else 0
        if c == '"':
            return _quoted(source, at, c, True)
    elif language == "swift":
        if c == "#" and (m := re.compile(r'(#+)("""|")').match(source, at)):
            end = source.find(m[2] + m[1], m.end())
            return end + len(m[2] + m[1]) if end >= 0 else len(source)
        if c == '"':
            return _with_code(source, at, '"""' if three else c, "\\(", ")", language, three)
    elif language in ("c", "cpp"):
        if c == "R" and language == "cpp" and (m := re.compile(r'R"([^()\\\s]{0,16})\(').match(source, at)):
            end = source.find(f"){m[1]}\"", m.end())
            return end + len(m[1]) + 2 if end >= 0 else len(source)
    if three and language == "java":
        return _quoted(source, at, '"""', True)
    return _quoted(source, at, c) if c in "\"'" else 0


def tokens(source: str, language: str, at: int = 0):
    """Tokens from `at` on."""
    before, heredocs, fresh = "\n", [], True
    while at < len(source):
        c = source[at]
        if fresh and language in ("c", "cpp") and c in " \t#" and _DIRECTIVE.match(source, at):
            at = _directive(source, at)
            continue
        if language == "ruby" and c == "_" and before == "\n" and re.compile(r"__END__\s*$", re.M).match(source, at):
            return
        if c in "/\"'`#=:%?rbR" and (end := _literal(source, at, c, language, before)):
            if end > 0:
                yield Token('"', at, end)
                before, fresh = '"', False
            at = abs(end)
            continue
        if language == "ruby" and c == "<" and (m := _HEREDOC.match(source, at)) and (m["a"] or before in _BEFORE_REGEX or before == '"' or m["p"]):
            heredocs.append(m["a"] or m["b"])
            yield Token('"', at, m.end())
            before, at = '"', m.end()
            continue
        m = (_JS_WORD.match(source, at) if language in ("js", "ts") else None) or _PLAIN.match(source, at)
        if m.lastgroup == "blank":
            at = m.end()
            continue
        yield Token(m[0], at, m.end())
        before, fresh, at = m[0], m[0] == "\n", m.end()
        if fresh and heredocs:
            at, heredocs = _heredocs(source, at, heredocs), []


def blanked(source: str, language: str) -> str:
    """The source with comments, strings and preprocessor lines as spaces, of the same length."""
    out, at = [], 0
    for t in tokens(source, language):
        out.append(re.sub(r"[^\n]", " ", source[at : t.start]))
        out.append(source[t.start : t.end] if t.text != '"' else re.sub(r"[^\n]", " ", source[t.start : t.end]))
        at = t.end
    return "".join(out) + re.sub(r"[^\n]", " ", source[at:])
