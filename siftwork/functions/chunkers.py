"""Chunkers: source text to chunks at functions and types.

Python uses ast. Other languages are read as tokens (lexer.py) by a stack of open brackets, or of what waits for
an `end`; each holds the statement so far, and where a body opens or a statement ends, its tokens tell
whether it is a declaration. A container that holds another
declaration gives way to it, nested functions fold into the outer one, non-blank text before the
first chunk is a `file` chunk, and text between and after chunks is not indexed. Anything without a
declaration, or that cannot be parsed, is one `file` chunk.
"""

from __future__ import annotations

import ast
import bisect
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from . import lexer

#: Languages by extension, case-sensitive (fixed values).
EXTENSIONS = {
    "rs": "rust", "py": "python", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ts": "ts", "mts": "ts", "cts": "ts", "tsx": "ts",
    "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "rb": "ruby", "swift": "swift",
}
CONTAINERS = {"impl", "class", "struct", "interface", "module"}
SCHEMA = "path string, chunk_ord int, start_line int, end_line int, chunk_kind string, name string, content string"


@dataclass
class Node:
    start: int
    end: int
    kind: str
    name: str = ""


@dataclass
class Chunk:
    start_line: int
    end_line: int
    kind: str
    content: str
    name: str = ""


#: For C and C++, what stands between the last ; { or } and an opening brace.
_C_TYPE = {"c": re.compile(r"(?:typedef\s+|static\s+)*(?P<k>struct)\b\s*(?P<n>\w*)\s*\Z"), "cpp": re.compile(r"(?:typedef\s+|template\s*<[^{}]*>\s*)*(?P<k>struct|class)\b\s*(?P<n>\w*)[^()=]*\Z")}
_C_SKIP = re.compile(r"(?:\s+|(?:public|private|protected)\s*:(?!:))+")
_C_RETURNS = re.compile(r"[\w*&:<>~,\s\[\]]*\Z")
_C_NAME = re.compile(r"(?:operator\s*\S{1,3}|~?\w+)\Z")

# A declaration's head, as its tokens with a blank behind each; brackets with what they hold are one token. Group
# "n" is its name. Heads end where a body opens (BODY) or where the statement ends (ENDED).
_TYPED = r"(?:< .*> )?\(\) (?:: .*)?"
_BODY: dict[str, list[tuple[str, str]]] = {
    "rust": [("function", r"(?:pub (?:\(\) )?|async |unsafe |const |default |safe |extern (?:\" )?)*fn (?:r # )?(?P<n>\w+) (?:< .*> )?\(\) .*"), ("impl", r"(?:unsafe |default )*impl .*")],
    "js": [("function", r"@MODS (?:async )?function (?:\* )?(?P<n>[\w$]*) ?" + _TYPED), ("class", r"@MODS (?:abstract )?class (?:(?!extends |implements )(?P<n>[\w$]+) )?.*"),
           ("method", r"(?:(?:public|private|protected|static|async|get|set|override|readonly|accessor) )*(?:\* )?(?P<n>[\w$#]+|\"|\[\]) " + _TYPED)],
    "go": [("function", r"func (?:\(\) )?(?P<n>\w+) (?:\[\] )?\(\) .*")],
    "java": [("class", r"@MODS class (?P<n>\w+) .*"), ("interface", r"@MODS interface (?P<n>\w+) .*"), ("enum", r"@MODS enum (?P<n>\w+) .*"), ("method", r"@MODS (?!record \w+ (?:< .*> )?\(\) )(?:< [^()]*> )?(?:[\w.<>,?&@ ]|\[\])*?(?P<n>\w+) \(\) (?:\[\] )*(?:throws .*)?")],
    "swift": [("function", r"@MODS func (?P<n>\w+|[^\w\s(]+(?: [^\w\s(]+)*) (?:< .*> )?\(\) .*"), ("function", r"@MODS init (?:[?!] )?(?:< .*> )?\(\) .*"), ("function", r"@MODS deinit "),
              ("class", r"@MODS (?:class|struct|enum|extension|actor) (?P<n>\w+) .*"), ("interface", r"@MODS protocol (?P<n>\w+) .*")],
}
_BODY["ts"] = [*_BODY["js"], ("interface", r"@MODS interface (?P<n>[\w$]+) .*")]
_ENDED: dict[str, list[tuple[str, str]]] = {"js": [("function", r"@MODS (?:const|let) (?P<n>[\w$]+) (?:: .*)?= (?:async )?(?:function .*|(?:(?:< .*> )?\(\) (?:: .*)?|[\w$]+ )=> .*)")], "go": [("type", r"type (?:(?P<n>\w+) .*|\(\) )")]}
_ENDED["ts"] = _ENDED["js"]
_MODS = {
    "js": "(?:(?:export|default|declare) )*", "ts": "(?:(?:export|default|declare) )*",
    "java": r"(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp|sealed|non - sealed|transient|volatile) |@ (?!interface )\w+ (?:\. \w+ )*(?:\(\) )?)*",
    "swift": r"(?:(?:public|private|fileprivate|internal|open|package|static|class|final|override|mutating|nonmutating|convenience|required|indirect|nonisolated|isolated|prefix|postfix|infix|dynamic|distributed) (?:\(\) )?|@ \w+ (?:\(\) )?)*",
}


def _compiled(heads: dict[str, list[tuple[str, str]]]) -> dict:
    return {k: [(kind, re.compile(p.replace("@MODS ", _MODS.get(k, "")), re.S)) for kind, p in v] for k, v in heads.items()}


_BODIES, _ENDS = _compiled(_BODY), _compiled(_ENDED)
#: What stands before a declaration without being part of it.
_AHEAD = {"js": re.compile(r"(?:@ [\w$]+ (?:\. [\w$]+ )*(?:\(\) )?)+"), "rust": re.compile(r"(?:# (?:! )?\[\] )+")}
_AHEAD["ts"] = _AHEAD["js"]
_NOT_METHODS = {"if", "for", "while", "switch", "catch", "return", "else", "do", "synchronized", "function", "new", "try", "with", "throw", "case", "assert", "yield", "await", "typeof"}
_NO_METHOD = re.compile(r"(?:else|return|new|throw)\b")
#: A brace after one of these opens a value or a type, not a body.
_VALUE = {
    "js": {"=", "(", "[", ",", ":", "?", "&", "|", "+", "<", "!", "&&", "||", "==", "return", "typeof", "in", "of", "extends", "as", "satisfies", "default", "yield", "await", "export", "import", "from", "?? "},
    "go": {"interface", "struct", "=", "(", ",", ":"}, "swift": {"=", "(", ",", ":", "return", "[", "&&", "||"}, "rust": set(), "java": {"=", "]", "[]", ","},
}
_VALUE["ts"] = _VALUE["js"]
#: Words that do not end a statement, and words that do not begin one, where lines end statements.
_GOES_ON = {"export", "default", "function", "class", "const", "let", "async", "static", "extends", "implements", "new", "typeof", "await", "abstract", "declare", "interface", "func", "type", "public", "private", "internal", "struct", "enum", "extension", "protocol", "where", "final", "override", "case", "in", "of", "=>"}
_FOLLOWS = {"extends", "implements", "in", "of", "instanceof", "as", "satisfies", "else", "catch", "is"}
_FOLLOWS_SWIFT = _FOLLOWS | {"where", "throws", "async", "rethrows"}
_CLOSERS = {"(": ")", "[": "]", "{": "}"}
#: Tokens of a head that are looked at.
_HEAD = 200
#: Characters of chunks that are held before they are passed on.
HELD = 4 << 20


class _Frame:
    """What is open: a bracket, its declaration if it is a body, and the statement so far."""

    def __init__(self, opener: str, at: int, node: Node | None = None, value: bool = False):
        self.opener, self.at, self.node, self.value = opener, at, node, value
        self.head: list[tuple[str, int, int, str]] = []  # of a bracket also its first word
        self.first = ""  # its first word


def _judge(frame: _Frame, heads: list, language: str) -> Node | None:
    """The declaration that a statement's head makes."""
    head = frame.head[:_HEAD]
    text = "".join(f"{t} " for t, *_ in head)
    ahead = _AHEAD[language].match(text) if language in _AHEAD else None
    skipped = text[: ahead.end()].count(" ") if ahead else 0
    text = text[ahead.end() :] if ahead else text
    for kind, pattern in heads:
        m = pattern.fullmatch(text)
        if not m or skipped >= len(head):
            continue
        name = (m.groupdict().get("n") or "").strip()
        if kind == "method":
            first = text.split(" ", 1)[0]
            if name in _NOT_METHODS or first in _NOT_METHODS:
                continue
        return Node(head[skipped][1], 0, kind.replace("method", "function"), name)
    return None


def _braced(source: str, language: str) -> list[Node]:
    """Declarations by a stack of open brackets, each with the statement that it stands in."""
    out: list[Node] = []
    stack = [_Frame("", 0)]
    lines = language in ("js", "ts", "go", "swift")
    bodies, ends, value = _BODIES[language], _ENDS.get(language, []), _VALUE[language]
    follows = _FOLLOWS_SWIFT if language == "swift" else _FOLLOWS
    broke = False  # a line ended before this token

    def finish(frame: _Frame, end: int) -> None:
        if frame.head and ends and (language != "go" or len(stack) == 1) and frame.head[0][0] in ("const", "let", "type", "export"):
            node = _judge(frame, ends, language)
            if node:
                node.end = end
                node.name = node.name or frame.head[1][3] if node.kind == "type" else node.name
                out.append(node)
        frame.head = []

    for token in lexer.tokens(source, language):
        text, start, end = token
        frame = stack[-1]
        if text == "\n":
            broke = True
            continue
        head = frame.head
        if broke and lines and head and frame.opener in ("", "{"):
            last = head[-1][0]
            word = text[0].isalnum() or text[0] in "_$#@\"}" or (language == "swift" and text == "(")
            plain = last[-1].isalnum() or last[-1] in "_$)]}\""
            # In Go a line ends its statement after such a token, whatever follows.
            if plain and (language == "go" or (word and last not in _GOES_ON and text not in follows)):
                finish(frame, head[-1][2])
                head = frame.head
        broke = False
        if text in _CLOSERS:
            node, kept = None, True
            if text == "{":
                kept = bool(head) and head[-1][0] in value
                node = None if kept or frame.opener in ("(", "[") else _judge(frame, bodies, language)
            stack.append(_Frame(text, start, node, kept))
        elif text in (")", "]", "}"):
            if len(stack) == 1 or _CLOSERS[frame.opener] != text:
                if text != "}" or not any(f.opener == "{" for f in stack):
                    continue  # nothing of this kind is open
                while stack[-1].opener != "{":
                    stack.pop()
                frame = stack[-1]
            if text == "}":
                finish(frame, frame.head[-1][2] if frame.head else start)
            stack.pop()
            outer = stack[-1]
            if frame.node:
                frame.node.end = end
                out.append(frame.node)
                outer.head = []
            elif text == "}" and not frame.value and not any(t in ("=", "=>", "return", "new", "->", "let", "const", "var") for t, *_ in outer.head[:_HEAD]):
                outer.head = []  # a block ends its statement
            else:
                outer.head.append((frame.opener + text, frame.at, end, frame.first))
        elif text == ";" and frame.opener in ("", "{"):
            finish(frame, end)
        elif text == "," and frame.opener == "{" and frame.value:
            frame.head = []
        else:
            if not frame.first and (text[0].isalpha() or text[0] == "_"):
                frame.first = text
            head.append((text, start, end, ""))
            if len(head) > 4 * _HEAD and text == ",":
                del head[_HEAD:]  # a long list of values
    finish(stack[0], stack[0].head[-1][2] if stack[0].head else len(source))
    return out


def _c(source: str, language: str) -> list[Node]:
    """Types and functions of C and C++: each opening brace is judged by what stands before it, once."""
    code = lexer.blanked(source, language)
    out: list[Node] = []
    opened: list[Node | None] = []
    last = 0
    for m in re.finditer(r"[;{}]", code):
        at, kind = m.start(), m[0]
        if kind == "}":
            if not opened:
                raise ValueError("braces do not match")
            if node := opened.pop():
                node.end = m.end()
                out.append(node)
        elif kind == "{":
            skipped = _C_SKIP.match(code, last, at)
            start = skipped.end() if skipped else last
            opened.append(_c_node(code[start:at], start, language))
        last = m.end()
    if opened:
        raise ValueError("braces do not match")
    return out


def _c_node(head: str, start: int, language: str) -> Node | None:
    if m := _C_TYPE[language].match(head):
        skip = re.match(r"typedef\s+", head)
        return Node(start + (skip.end() if skip else 0), 0, m["k"], m["n"])
    left, right = head.find("("), head.rfind(")")
    if left < 0 or right < left or "=" in head[right:]:
        return None
    before = head[:left].rstrip()
    name = _C_NAME.search(before[-200:])
    if not name or name[0] in _NOT_METHODS or not _C_RETURNS.match(before[: len(before) - len(name[0])]) or _NO_METHOD.match(head):
        return None
    return Node(start, 0, "function", name[0])


def _python(source: str) -> list[Node]:
    lines = [0]
    for x in source.split("\n"):
        lines.append(lines[-1] + len(x.encode()) + 1)
    data = source.encode()
    out = []
    for n in ast.walk(ast.parse(source)):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            a, b = lines[n.lineno - 1] + n.col_offset, lines[n.end_lineno - 1] + n.end_col_offset
            a, b = len(data[:a].decode()), len(data[:b].decode())
            out.append(Node(a, b, "class" if isinstance(n, ast.ClassDef) else "function", n.name))
    return out


_RUBY_NAME = re.compile(r"[ \t]*(?:[\w@]+[ \t]*\.[ \t]*)?(?P<n>[^\W\d]\w*(?:[?!]|=(?=\())?|[-+!~]@|\[\]=?|[^\w\s(]+)")
_RUBY_ENDLESS = re.compile(r"[ \t]*=(?![=~>])")
_RUBY_MODIFIERS = {"if", "unless", "while", "until"}
_RUBY_BEFORE = set("=([{,|;\n!?:&") | {"\n", "&&", "||", "=>", "then", "else", "do", "and", "or", "not", "ensure", "begin", "+=", "->", "=="}


def _ruby(source: str) -> list[Node]:
    """Methods, classes and modules, by a stack of what waits for an `end`."""
    stack: list[Node | None] = []
    out: list[Node] = []
    endless: list[tuple[Node, int]] = []  # methods that end with their line, and the depth of brackets there
    before, then, past, depth, loop = "\n", "", 0, 0, False
    every = list(lexer.tokens(source, "ruby"))
    for i, (text, start, end) in enumerate(every):
        then = every[i + 1].text if i + 1 < len(every) else "\n"
        if start < past:
            continue  # the name of a method
        depth += (text in "([{") - (text in ")]}")
        if text in ("\n", ";"):
            while endless and depth <= endless[-1][1] and before not in _RUBY_BEFORE - {"\n"}:
                node, _ = endless.pop()
                node.end = every[i - 1].end
                out.append(node)
            loop = loop and text == "\n" and before in _RUBY_BEFORE - {"\n"}
        name = before in (".", "&.", "::", ":", "def") or (then == ":" and every[i + 1].start == end and not source.startswith("::", end)) or source[end : end + 1] in ("?", "!")
        first = before in _RUBY_BEFORE
        if not name and text == "def":
            m = _RUBY_NAME.match(source, end)
            node = Node(start, 0, "function", m["n"] if m else "")
            past = m.end() if m else end
            at = past
            if source[at : at + 1] == "(":
                level = 0
                for t in lexer.tokens(source, "ruby", at):
                    level += (t.text == "(") - (t.text == ")")
                    at = t.end
                    if not level:
                        break
            if _RUBY_ENDLESS.match(source, at):
                endless.append((node, depth))
            else:
                stack.append(node)
        elif not name and text in ("class", "module"):
            m = re.compile(r"[ \t]+(?P<n>[A-Z][\w:]*)").match(source, end)
            stack.append(Node(start, 0, text, m["n"]) if m else None)
        elif not name and (text in ("begin", "case") or text == "for" and first or text in _RUBY_MODIFIERS and first):
            stack.append(None)
            loop = loop or text in ("while", "until", "for")
        elif not name and text == "do":
            if not loop:
                stack.append(None)
            loop = False
        elif not name and text == "end":
            if not stack:
                raise ValueError("nothing to end")
            node = stack.pop()
            if node:
                node.end = end
                out.append(node)
        before = text
    for node, _ in endless:
        node.end = len(source.rstrip())
        out.append(node)
    if stack:
        raise ValueError("end is missing")
    return out


def chunk_source(extension: str, source: str) -> list[Chunk] | None:
    """Chunks of a known language; None where the whole file is to be one."""
    language = EXTENSIONS.get(extension)
    if language is None:
        return None
    try:
        nodes = _python(source) if language == "python" else _ruby(source) if language == "ruby" else _c(source, language) if language in ("c", "cpp") else _braced(source, language)
    except (SyntaxError, ValueError, IndexError, RecursionError):
        return None
    # Nodes nest, so what a container holds first begins right after it.
    nodes.sort(key=lambda n: (n.start, -n.end))
    nodes = [n for n, then in zip(nodes, [*nodes[1:], None]) if n.kind not in CONTAINERS or then is None or then.end > n.end]
    kept: list[Node] = []
    for n in nodes:
        if not kept or n.start >= kept[-1].end:
            kept.append(n)
    if not kept:
        return None
    breaks = [m.start() for m in re.finditer("\n", source)]
    row = lambda at: bisect.bisect_left(breaks, at) + 1
    out = []
    head = source[: kept[0].start]
    if head.strip():
        out.append(Chunk(1, head.count("\n") + 1, "file", head.strip()))
    return out + [Chunk(row(n.start), row(n.end), n.kind, source[n.start : n.end], n.name) for n in kept]


def chunk_or_whole_file(extension: str, source: str) -> list[Chunk]:
    lines = source.count("\n") + (not source.endswith("\n")) if source else 0
    return chunk_source(extension, source) or [Chunk(1, max(lines, 1), "file", source)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in SCHEMA.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == "int" else pa.string()) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def chunk_files(files: DataFrame) -> DataFrame:
    """SCHEMA rows of files (path, content), which are read one by one from a batch; HELD characters of chunks are held, or one file's."""

    def run(batches):
        for b in batches:
            rows, size = [], 0
            for path, content in zip(b.column(0), b.column(1), strict=True):
                path = path.as_py()
                name = path.rsplit("/", 1)[-1]
                extension = name.rsplit(".", 1)[1] if "." in name[1:] else ""
                for i, c in enumerate(chunk_or_whole_file(extension, content.as_py() or "")):
                    rows.append((path, i, c.start_line, c.end_line, c.kind, c.name, c.content))
                    size += len(c.content)
                if size > HELD:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return files.select("path", "content").mapInArrow(run, SCHEMA)
