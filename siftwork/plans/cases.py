"""Queries on stated cases and on stores, folders and embedders, with SQL that holds or computes what they must return."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunkers, rank, text
from ..functions.embed import HashingEmbedder, embed_udf
from ..operators import search
from ..operators.store import ChunkStore
from ..session import read, ship, shared_dir
from ..sources import folder as source
from ..streaming import watch
from . import catalogue

#: Source files: path, lines, and their chunks as (first line, last line, kind, name).
FILES = [
    ("/x/a.rs", ["use a::B;", "const N: u8 = 1;", "", "fn one() { if x { y } }", "", "struct P { a: u8 }", "", "impl P {", "    fn get(&self) -> u8 { 1 }", "    pub fn set(&mut self) { \"}\"; }", "}"], [(1, 4, "file", ""), (4, 4, "function", "one"), (9, 9, "function", "get"), (10, 10, "function", "set")]),
    ("/x/b.rs", ["impl Empty {}"], [(1, 1, "impl", "")]),
    ("/x/c.rs", ["fn a() {", "    fn b() {}", "}"], [(1, 3, "function", "a")]),
    ("/x/d.rs", ["const A: u8 = 1;"], [(1, 1, "file", "")]),
    ("/x/a.py", ["import os", "", "def f(a):", "    return 'é'", "", "class C:", "    def g(self):", "        pass"], [(1, 3, "file", ""), (3, 4, "function", "f"), (7, 8, "function", "g")]),
    ("/x/b.py", ["def ("], [(1, 1, "file", "")]),
    ("/x/a.js", ["import x from 'x';", "function a() { return `}`; }", "const b = (q) => { return q; };", "class C {", "  m() { return 1; }", "}"], [(1, 2, "file", ""), (2, 2, "function", "a"), (3, 3, "function", "b"), (5, 5, "function", "m")]),
    ("/x/b.js", ["export default class extends Base {", "}"], [(1, 2, "class", "")]),
    ("/x/a.ts", ["interface I {", "  a: string;", "}", "", "function f(): void {}"], [(1, 3, "interface", "I"), (5, 5, "function", "f")]),
    ("/x/a.go", ["package p", "", "type T struct {", "\ta int", "}", "", "func (t T) M() int { return 1 }", "", "func F(a int,", "\tb int) int {", "\treturn a", "}"], [(1, 3, "file", ""), (3, 5, "type", "T"), (7, 7, "function", "M"), (9, 12, "function", "F")]),
    ("/x/A.java", ["package p;", "public class A {", "  int x;", "  public A() { x = 1; }", "  int get() { return x; }", "}"], [(1, 4, "file", ""), (4, 4, "function", "A"), (5, 5, "function", "get")]),
    ("/x/Q.java", ["interface Q {", "  int a();", "}"], [(1, 3, "interface", "Q")]),
    ("/x/a.c", ["#include <a.h>", "struct s { int a; };", "int f(int x) {", "  return x;", "}", "int g(void);"], [(1, 2, "file", ""), (2, 2, "struct", "s"), (3, 5, "function", "f")]),
    ("/x/b.c", ["static int", "h(int a,", "  int b)", "{", "  return b;", "}"], [(1, 6, "function", "h")]),
    ("/x/a.cpp", ["#include <a>", "class K {", " public:", "  int a() { return 1; }", "  void b() {}", "};", "int main() { return 0; }"], [(1, 4, "file", ""), (4, 4, "function", "a"), (5, 5, "function", "b"), (7, 7, "function", "main")]),
    ("/x/b.cpp", ["struct P { int a; };"], [(1, 1, "struct", "P")]),
    ("/x/a.rb", ["require 'x'", "class A", "  def a", "    if x", "      1", "    end", "  end", "  def self.b", "  end", "end"], [(1, 3, "file", ""), (3, 7, "function", "a"), (8, 9, "function", "b")]),
    ("/x/a.swift", ["import F", "class A {", "  func a() {}", "}", "protocol P { func q() }"], [(1, 3, "file", ""), (3, 3, "function", "a"), (5, 5, "interface", "P")]),
    ("/x/a.cs", ["class A {}", ""], [(1, 2, "file", "")]),
]
#: First line, mark of a comment, and last line of a file with one function, by extension.
WRAPPERS = {
    "rs": ("fn f() {", "//", "}"), "py": ("def f():", "#", "    pass"), "js": ("function f() {", "//", "}"), "ts": ("function f(): void {", "//", "}"), "go": ("func f() {", "//", "}"), "java": ("void f() {", "//", "}"),
    "c": ("void f(void) {", "//", "}"), "cpp": ("void f() {", "//", "}"), "rb": ("def f", "#", "end"), "swift": ("func f() {", "//", "}"), "md": ("# f", "", "end"),
}
FUZZY = "aelt"


def _chunks(s: SparkSession, d: str) -> DataFrame:
    """A file for each document, which of FILES by turns of doc_id."""
    ship(s)
    place = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(len(FILES))).cast("int") + 1
    part = lambda of: F.element_at(F.array(*[F.lit(x) for x in of]), place)
    path = F.concat(F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), part([p for p, _, _ in FILES]))
    files = read(s, d, "documents").select(path.alias("path"), part(["\n".join(x) + "\n" for _, x, _ in FILES]).alias("content"))
    return chunkers.chunk_files(files).select("path", "chunk_ord", "start_line", "end_line", "chunk_kind", "name")


def _languages(s: SparkSession, d: str) -> DataFrame:
    """Every document as the comment in a function, in each language by turns of doc_id."""
    ship(s)
    docs = read(s, d, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x09\x0B-\x1F]", " ").alias("t"))
    place = (F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(len(WRAPPERS))) + 1).cast("int")
    part = lambda of: F.element_at(F.array(*[F.lit(x) for x in of]), place)
    first, mark, last = (part([w[i] for w in WRAPPERS.values()]) for i in range(3))
    content = F.concat(first, F.lit("\n"), mark, F.replace("t", F.lit("\n"), F.concat(F.lit("\n"), mark)), F.lit("\n"), last)
    path = F.concat(F.lit("/x/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit("."), part(list(WRAPPERS)))
    got = chunkers.chunk_files(docs.select(path.alias("path"), content.alias("content")))
    return got.select("path", "chunk_ord", "start_line", "end_line", "chunk_kind", "name", F.md5(F.col("content").cast("binary")).alias("md5"))


def _languages_sql() -> str:
    rows = ", ".join(f"({i}, {_literal(e)}, {_literal(a)}, {_literal(m)}, {_literal(z)})" for i, (e, (a, m, z)) in enumerate(WRAPPERS.items()))
    text = f"WITH w(i, ext, a, m, z) AS (VALUES {rows}), d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x00-\x09\x0B-\x1F]', ' ', 'g') AS t FROM documents)"
    return text + (
        " SELECT '/x/' || coalesce(doc_id::VARCHAR, 'none') || '.' || ext AS path, 0 AS chunk_ord, 1 AS start_line, (3 + length(t) - length(replace(t, chr(10), '')))::INT AS end_line,"
        " CASE WHEN ext = 'md' THEN 'file' ELSE 'function' END AS chunk_kind, CASE WHEN ext = 'md' THEN '' ELSE 'f' END AS name, md5(a || chr(10) || m || replace(t, chr(10), chr(10) || m) || chr(10) || z) AS md5"
        f" FROM d JOIN w ON coalesce(doc_id, 0) % {len(WRAPPERS)} = i"
    )


def _literal(x) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def _chunks_sql() -> str:
    rows = ", ".join(f"({f}, {_literal(p)}, {i}, {a}, {b}, {_literal(k)}, {_literal(n)})" for f, (p, _, each) in enumerate(FILES) for i, (a, b, k, n) in enumerate(each))
    return f"WITH t(f, path, chunk_ord, start_line, end_line, chunk_kind, name) AS (VALUES {rows}) SELECT '/' || coalesce(doc_id::VARCHAR, 'none') || path AS path, chunk_ord, start_line, end_line, chunk_kind, name FROM documents JOIN t ON coalesce(doc_id, 0) % {len(FILES)} = f"


#: By extension: first lines, lines of a member, and last lines of a file of nested declarations. In them %n is the
#: member's number and %t a document's text; (first, last, kind, name) are the member's chunk, and a chunk at the end.
NESTED = {
    "rs": (["use x::Y; // %t", "impl<T> Z<T> where T: Q {"], ["    /* %t /* nested } */ { */", "    pub(crate) async fn m%n<'a>(s: &'a str) -> [u8; 2] {", "        let t = r#\"%t } \" {\"#;", "        if x { fn inner() {} }", "    }"], ["}"], (2, 5, "function", "m%n"), None),
    "js": (["import x from 'x' // %t", "export default class K extends mixin({a: 1}) {"], ["  f%n = 5", "  async *m%n({a}, b = {}) {", "    return `%t }${ {a: `{`} } {` + x / /[}/]{/.source", "  }"], ["}", "const z = (a) => a + 1"], (2, 4, "function", "m%n"), (1, 1, "function", "z")),
    "ts": (["// %t", "export class A<T extends {a: 1}> {"], ["  private m%n(a: {b: string}): {c: number} {", "    return '%t } {' as any", "  }"], ["}", "export interface I<T> extends J { k(): void }"], (1, 3, "function", "m%n"), (1, 1, "interface", "I")),
    "go": (["package p // %t", "type (", "\tA struct { x int }", "\tB int", ")"], ["func (t *T[K]) M%n(f func() interface{}) (map[string]struct{}, error) {", "\ts := `%t } {`", "\treturn nil, nil", "}"], [], (1, 4, "function", "M%n"), None),
    "java": (["package p; /* %t */", "record R<T>(int a) {"], ["  @Override @A(b = \"{\") public <K> Map<K, List<T>> m%n(F<? super K> f) throws E {", "    Runnable r = () -> { go(\"%t } {\"); };", "  }"], ["}", "@interface N { int a() default 1; }", "enum E { X { int v() { return 1; } }, Y }"], (1, 3, "function", "m%n"), (2, 2, "enum", "E")),
    "c": (["#include <a.h> /* %t */", "#define BEGIN {"], ["#ifdef W", "static int *f%n(int a) {", "#else", "static int *f%n(void) {", "#endif", "  return \"%t } {\";", "}"], [], (2, 7, "function", "f%n"), None),
    "cpp": (["// %t", "namespace n {", "class Q final : public R<int> {"], [" public:", "  T m%n() const {", "    return R\"x(%t } \" {)x\";", "  }"], ["};", "}"], (2, 4, "function", "m%n"), None),
    "rb": (["# %t", "class A < B"], ["  private def m%n(k)", "    x = if y then \"%t } end\" else <<~Q end", "      end def class", "    Q", "    h = {if: 1, class: :end} while z.class", "    while x do break end", "  end"], ["  class << self; def e = 1; end", "end"], (1, 7, "function", "m%n"), (0, 0, "function", "e")),
    "swift": (["import F // %t", "public final class A: B {"], ["  override func m%n<T>(_ x: T) -> [T] where T: C {", "    let s = #\"%t } \" {\"#; return f(\"\\(x.map { \"}\" })\")", "  }"], ["}", "protocol P { func q() }"], (1, 3, "function", "m%n"), (1, 1, "interface", "P")),
    "py": (["import x # %t", "class A:"], ["    @d('def f():')", "    async def m%n(self, a='}'):", "        def inner(): pass", "        return '%t def class'"], ["", "class B: pass"], (2, 4, "function", "m%n"), (1, 1, "class", "B")),
}
#: The chunk before the first member, from line 1: where it ends (from the first lines' end), and chunks that stand within the first lines.
HEADED = {"go": (2, 5, "type", "A")}


def _nested(s: SparkSession, d: str) -> DataFrame:
    """Every document as the text in a file of 1 to 3 nested declarations, in each language by turns of doc_id."""
    ship(s)
    safe = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 ;(){}\u00e0-\u00ff]", " ")
    docs = read(s, d, "documents").select(F.coalesce("doc_id", F.lit(0)).alias("id"), safe.alias("t"))
    place = (F.pmod("id", F.lit(len(NESTED))) + 1).cast("int")
    part = lambda of: F.element_at(F.array(*[F.lit("\n".join(x)) for x in of]), place)
    first, member, last = (part([w[i] for w in NESTED.values()]) for i in range(3))
    count = (F.col("id") / len(NESTED)).cast("long") % 3 + 1
    members = F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), count), lambda n: F.replace(member, F.lit("%n"), n.cast("string"))), "\n")
    content = F.replace(F.concat(first, F.lit("\n"), members, F.lit("\n"), last, F.lit("\n")), F.lit("%t"), F.col("t"))
    path = F.concat(F.lit("/n/"), F.col("id").cast("string"), F.lit("."), F.element_at(F.array(*[F.lit(x) for x in NESTED]), place))
    got = chunkers.chunk_files(docs.select(path.alias("path"), content.alias("content")))
    return got.select("path", "start_line", "end_line", "chunk_kind", "name")


def _nested_sql() -> str:
    heads, members, tails = [], [], []
    for i, (ext, (first, member, last, (a, b, kind, name), tail)) in enumerate(NESTED.items()):
        h, m = len(first), len(member)
        if ext in HEADED:
            x, y, k, n = HEADED[ext]
            heads += [(i, 1, x, "file", ""), (i, x, y, k, n)]
        else:
            heads.append((i, 1, h + a, "file", ""))
        members.append((i, ext, h, m, a, b, kind, name.replace("%n", "")))
        if tail:
            tails.append((i, tail[0] + 1, tail[1] + 1, tail[2], tail[3]))
    values = lambda rows: ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"""WITH m(i, ext, h, m, a, b, kind, name) AS (VALUES {values(members)}), h(i, a, b, kind, name) AS (VALUES {values(heads)}), t(i, a, b, kind, name) AS (VALUES {values(tails)}),
d AS (SELECT coalesce(doc_id, 0) AS id, coalesce(doc_id, 0) // {len(NESTED)} % 3 + 1 AS k, m.* FROM documents JOIN m ON coalesce(doc_id, 0) % {len(NESTED)} = m.i),
e AS (SELECT *, unnest(range(1, k + 1)) AS n FROM d)
SELECT '/n/' || id || '.' || ext AS path, (h + (n - 1) * m + a)::INT AS start_line, (h + (n - 1) * m + b)::INT AS end_line, kind AS chunk_kind, name || n AS name FROM e
UNION ALL SELECT '/n/' || id || '.' || ext, h.a, h.b, h.kind, h.name FROM d JOIN h USING (i)
UNION ALL SELECT '/n/' || id || '.' || ext, (d.h + k * m + t.a)::INT, (d.h + k * m + t.b)::INT, t.kind, t.name FROM d JOIN t USING (i)"""


def _fuzzy_sql(names: str, query: str) -> str:
    """CTEs f(name, raw): the best alignment of a lower-case query in names, a step for each of its characters.

    A character counts 16, and 8 more where a word starts; 6 more next to the one before; a gap of g counts -(2 + g).
    """
    ctes = [f"n AS ({names})", "p AS (SELECT name, i, lower(substr(name, i, 1)) AS c, 16 + CASE WHEN i = 1 OR NOT regexp_matches(substr(name, i - 1, 1), '[\\p{L}\\p{N}]') OR (regexp_matches(substr(name, i, 1), '\\p{Lu}') AND regexp_matches(substr(name, i - 1, 1), '\\p{Ll}')) THEN 8 ELSE 0 END AS v FROM (SELECT name, unnest(range(1, length(name) + 1)) AS i FROM n))"]
    for k, c in enumerate(query):
        if k:
            ctes.append(f"e{k} AS (SELECT p.name, p.i, p.v + max(CASE WHEN b.i = p.i - 1 THEN b.e + 6 ELSE b.e - 2 - (p.i - 1 - b.i) END) AS e FROM p JOIN e{k - 1} b ON p.name = b.name AND b.i < p.i WHERE p.c = {_literal(c)} GROUP BY p.name, p.i, p.v)")
        else:
            ctes.append(f"e0 AS (SELECT name, i, v AS e FROM p WHERE c = {_literal(c)})")
    ctes.append(f"f AS (SELECT n.name, greatest(coalesce(max(e), 0), 0) AS raw FROM n LEFT JOIN e{len(query) - 1} e ON n.name = e.name GROUP BY n.name)")
    return ", ".join(ctes)


def _hybrid(s: SparkSession, d: str) -> DataFrame:
    hits = search.hybrid_search(catalogue.chunks(s, d), "md", catalogue.vector_of(s, d), catalogue.K, as_question=False)
    return hits.select("path", "start_line", F.round("score", 6).alias("score"))


def _embedded(s: SparkSession, d: str) -> DataFrame:
    """Sums over each document's vector that show place, sign and length of it."""
    ship(s)
    e = read(s, d, "documents").select("doc_id", embed_udf(HashingEmbedder(64))(F.coalesce("text", F.lit(""))).alias("e"))
    total = lambda f: F.round(F.aggregate(F.transform("e.embedding", f), F.lit(0.0), lambda a, x: a + x) + F.lit(0.0), 3)
    return e.select("doc_id", "e.truncated", total(lambda x, i: x.cast("double") * (i + 1)).alias("place"), total(lambda x, i: F.abs(x.cast("double"))).alias("size"), total(lambda x, i: x.cast("double") * x).alias("norm"))


_EMBED_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '([a-z])([A-Z])', '\1 \2', 'g')), '[\p{L}\p{N}]+') AS w FROM documents),
t AS (SELECT doc_id, len(w) > 512 AS truncated, w[1:512] AS w FROM w),
x AS (SELECT doc_id, unnest(w) AS x, 1.0::DOUBLE AS v FROM t UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 0.5 FROM t),
h AS (SELECT doc_id, v, md5(x) AS m FROM x),
b AS (SELECT doc_id, ('0x' || substr(m, 1, 2))::INT % 64 AS i, CASE WHEN ('0x' || substr(m, 3, 2))::INT % 2 = 1 THEN v ELSE -v END AS v FROM h),
s AS (SELECT doc_id, i, sum(v) AS v FROM b GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM s GROUP BY doc_id),
e AS (SELECT doc_id, i, (v / n)::FLOAT::DOUBLE AS v FROM s JOIN n USING (doc_id) WHERE n > 0)
SELECT t.doc_id, any_value(truncated) AS truncated, round(coalesce(sum(e.v * (i + 1)), 0) + 0.0, 3) AS place, round(coalesce(sum(abs(e.v)), 0), 3) AS size, round(coalesce(sum(e.v * e.v), 0), 3) AS norm
FROM t LEFT JOIN e USING (doc_id) GROUP BY t.doc_id
"""


def _store(s: SparkSession, d: str) -> tuple[ChunkStore, DataFrame]:
    """A new store that holds the code chunks of the test tables, imported as an older table without some columns."""
    ship(s)
    store = ChunkStore(s, f"{shared_dir(s)}/siftwork/store-{uuid.uuid4().hex}")
    code = catalogue.code(s, d)
    store.import_table(catalogue.CODE, code.drop("name", "truncated", "mtime", "chunk_ord"))
    return store, code


def _stored(s: SparkSession, d: str) -> DataFrame:
    """Import, replacement of some paths by other rows, deletion of a folder, and a read."""
    store, code = _store(s, d)
    label = F.element_at(F.split("path", "/"), -2).cast("int")
    new = code.filter(label == 1).withColumn("content", F.lit("new")).filter(F.col("mtime") % 2 == 0)
    store.replace(catalogue.CODE, code.filter(label == 1).select("path"), new)
    store.delete_under(catalogue.CODE + "/2/")
    return store.read().select("path", "content", "name", "mtime", F.size("embedding").alias("dim"))


def _log(s: SparkSession, d: str) -> DataFrame:
    """Ten deltas, of which some are merged, over a part that is laid out by cells, and a read."""
    store, code = _store(s, d)
    store.optimize(per_cell=256)
    for i in range(10):
        paths = code.filter(F.col("mtime") % 16 == i)
        store.replace(catalogue.CODE, paths.select("path"), paths.filter("mtime % 3 <> 0").withColumn("content", F.lit(f"v{i}")))
    return store.read().select("path", "content", "name")


def _bounded(query: str, question: bool):
    """hybrid_search over a store that reads only cells which can hold one of the best."""

    def run(s: SparkSession, d: str) -> DataFrame:
        ship(s)
        store = ChunkStore(s, f"{shared_dir(s)}/siftwork/store-{uuid.uuid4().hex}")
        store.import_table("/watched", catalogue.chunks(s, d))
        store.optimize(per_cell=256)
        hits = store.search(query, catalogue.vector_of(s, d), catalogue.K, as_question=question)
        return hits.select("path", "start_line", F.round("score", 6).alias("score"))

    return run


def _listed(s: SparkSession, d: str) -> DataFrame:
    """Files made of the benchmark texts in folders with ignore rules, listed by the source and read; paths below the root."""
    ship(s)
    source.register(s)
    root = os.path.realpath(shared_dir(s).removeprefix("file://")) + f"/siftwork/files-{uuid.uuid4().hex}"
    os.makedirs(root + "/deep/1")
    for name, rules in ((".gitignore", "*.log\n!2.log\n/deep/2/\n"), ("deep/.gitignore", "1/*.txt\n!1/**/7.txt\n")):
        with open(f"{root}/{name}", "w", encoding="utf-8") as f:
            f.write(rules)

    def write(batches):
        for b in batches:
            for path, content in zip(b["path"], b["text"], strict=True):
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "w", encoding="utf-8") as f:
                    f.write(content or "")
            yield b[["path"]]

    ext = F.element_at(F.array(F.lit(".md"), F.lit(".log"), F.lit(".txt"), F.lit(".rs")), (F.pmod("item_id", F.lit(4)) + 1).cast("int"))
    path = F.concat(F.lit(root + "/deep/"), F.pmod("item_id", F.lit(3)).cast("string"), F.lit("/"), F.col("item_id").cast("string"), ext)
    read(s, d, "benchmark").select(path.alias("path"), "text").mapInPandas(write, "path string").count()
    files = source.read_texts(s.read.format("folder").option("path", root).load())
    return files.select("op", F.substr("path", F.lit(len(root) + 2)).alias("path"), F.md5(F.col("content").cast("binary")).alias("md5"), F.coalesce("problem", F.lit("")).alias("problem"))


def _progress(s: SparkSession, d: str) -> DataFrame:
    files = catalogue.chat(s, d).select("path", F.when(F.col("start_line") == 3, "delete").otherwise("upsert").alias("op"))
    got = watch.progress(files, catalogue.chat(s, d).filter("start_line > 2"))
    return s.createDataFrame([(got["total"], got["indexed"], got["failed_count"], len(got["failed"]))], "total long, indexed long, failed_count long, shown long")


QUERIES = {
    "chunk_cases": _chunks, "chunk_nested": _nested, "chunk_languages": _languages, "hybrid_default_weights": _hybrid, "embedding_sums": _embedded, "store_round_trip": _stored, "store_log": _log, "bounded_search": _bounded("md", False), "bounded_search_question": _bounded(catalogue.QUERY, True), "folder_listing": _listed, "index_progress": _progress,
    "store_row_count": lambda s, d: s.createDataFrame([(_store(s, d)[0].row_count(),)], "n long"),
    "fuzzy_filename": lambda s, d: (ship(s), read(s, d, "part").select(F.col("p_name").alias("name")).distinct().withColumn("score", F.round(rank.fuzzy(FUZZY)("name"), 6)))[1],
    "blank_filter": lambda s, d: read(s, d, "documents").filter(~text.is_blank(F.coalesce("text", F.lit("")))).select("doc_id"),
    "result_lines": lambda s, d: catalogue.chunks(s, d).select("path", text.result_line(F.col("chunk_kind"), F.col("start_line") + 4, F.when(F.col("mtime") % 2 == 0, F.lit(9))).alias("line")),
}
SQL = {
    "chunk_cases": _chunks_sql(), "chunk_nested": _nested_sql(), "chunk_languages": _languages_sql(),
    "hybrid_default_weights": catalogue._BASE + ", " + _fuzzy_sql("SELECT DISTINCT regexp_extract(path, '[^/]*$') AS name FROM chunks", "md") + f", z AS (SELECT s.path, s.start_line, 0.55 * sem + 0.30 * (raw / (raw + 50.0)) AS score FROM s JOIN f ON regexp_extract(s.path, '[^/]*$') = f.name) SELECT path, start_line, round(score, 6) AS score FROM (SELECT * FROM z ORDER BY score DESC, path LIMIT {catalogue.K})",
    "embedding_sums": _EMBED_SQL,
    "store_round_trip": f"WITH c AS (SELECT '{catalogue.CODE}/' || label || '/' || vec_id || '.rs' AS path, vec_id, label, len(embedding)::INT AS dim FROM embeddings) SELECT path, CASE WHEN label = 1 THEN 'new' ELSE 'fn fn_' || vec_id || '() {{ the one }}' END AS content, CASE WHEN label = 1 THEN 'fn_' || vec_id ELSE '' END AS name, CASE WHEN label = 1 THEN vec_id ELSE 0 END AS mtime, dim FROM c WHERE label <> 2 AND (label <> 1 OR vec_id % 2 = 0)",
    "store_log": f"SELECT '{catalogue.CODE}/' || label || '/' || vec_id || '.rs' AS path, CASE WHEN vec_id % 16 < 10 THEN 'v' || (vec_id % 16) ELSE 'fn fn_' || vec_id || '() {{ the one }}' END AS content, CASE WHEN vec_id % 16 < 10 THEN 'fn_' || vec_id ELSE '' END AS name FROM embeddings WHERE vec_id % 16 >= 10 OR vec_id % 3 <> 0",
    "bounded_search_question": catalogue.SQL["hybrid_search_question"],
    "store_row_count": "SELECT count(*) AS n FROM embeddings",
    "folder_listing": """WITH b AS (SELECT item_id AS i, item_id % 3 AS f, CASE item_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.log' WHEN 2 THEN '.txt' ELSE '.rs' END AS x, coalesce(text, '') AS text FROM benchmark),
k AS (SELECT *, length(regexp_replace(text, '\\s', '', 'g')) = 0 AS blank FROM b WHERE f <> 2 AND (x <> '.log' OR i = 2) AND NOT (f = 1 AND x = '.txt' AND i <> 7))
SELECT 'scan' AS op, 'deep/' || f || '/' || i || x AS path, CASE WHEN NOT blank THEN md5(text) END AS md5, CASE WHEN blank THEN 'has no text' ELSE '' END AS problem FROM k""",
    "index_progress": "WITH f AS (SELECT DISTINCT conv_id FROM conversations WHERE turn <> 2), x AS (SELECT DISTINCT conv_id FROM conversations WHERE turn > 1) SELECT count(*) AS total, count(x.conv_id) AS indexed, count(*) - count(x.conv_id) AS failed_count, least(count(*) - count(x.conv_id), 20) AS shown FROM f LEFT JOIN x USING (conv_id)",
    "fuzzy_filename": "WITH " + _fuzzy_sql("SELECT DISTINCT p_name AS name FROM part", FUZZY) + " SELECT name, round(raw / (raw + 50.0), 6) AS score FROM f",
    "blank_filter": r"SELECT doc_id FROM documents WHERE length(regexp_replace(coalesce(text, ''), '\s', '', 'g')) > 0",
    "result_lines": catalogue._BASE + " SELECT path, CASE WHEN chunk_kind <> 'file' THEN start_line + 4 WHEN mtime % 2 = 0 THEN 9 ELSE 1 END AS line FROM chunks",
}
SQL["bounded_search"] = SQL["hybrid_default_weights"]
