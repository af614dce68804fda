import time

import pytest

from siftwork.functions.chunkers import chunk_or_whole_file, chunk_source

CASES = [
    ("rs", "use a::B;\nconst N: u8 = 1;\n\nfn one() { if x { y } }\n\nstruct P { a: u8 }\n\nimpl P {\n    fn get(&self) -> u8 { 1 }\n    pub fn set(&mut self) { \"}\"; }\n}\n", ["file", "function", "function", "function"], ["", "one", "get", "set"]),
    ("rs", "impl Empty {}\n", ["impl"], [""]),
    ("rs", "fn a() {\n    fn b() {}\n}\n", ["function"], ["a"]),
    ("py", "import os\n\nX = 1\n\ndef f(a):\n    return 'é'\n\nclass C:\n    def g(self):\n        pass\n    def h(self):\n        pass\n", ["file", "function", "function", "function"], ["", "f", "g", "h"]),
    ("js", "import x from 'x';\nfunction a() { return `}`; }\nconst b = (q) => { return q; };\nclass C {\n  m() { return 1; }\n}\n", ["file", "function", "function", "function"], ["", "a", "b", "m"]),
    ("ts", "interface I {\n  a: string;\n}\n\nfunction f(): void {}\n", ["interface", "function"], ["I", "f"]),
    ("go", "package p\n\nimport \"x\"\n\ntype T struct {\n\ta int\n}\n\nfunc (t T) M() int { return 1 }\n\nfunc F() {}\n", ["file", "type", "function", "function"], ["", "T", "M", "F"]),
    ("java", "package p;\npublic class A {\n  int x;\n  public A() { x = 1; }\n  int get() { return x; }\n}\n", ["file", "function", "function"], ["", "A", "get"]),
    ("java", "interface Q {\n  int a();\n}\n", ["interface"], ["Q"]),
    ("c", "#include <a.h>\nstruct s { int a; };\nint f(int x) {\n  return x;\n}\nint g(void);\n", ["file", "struct", "function"], ["", "s", "f"]),
    ("cpp", "#include <a>\nclass K {\n public:\n  int a() { return 1; }\n  void b() {}\n};\nint main() { return 0; }\n", ["file", "function", "function", "function"], ["", "a", "b", "main"]),
    ("rb", "require 'x'\nclass A\n  def a\n    if x\n      1\n    end\n  end\n  def self.b\n  end\nend\n", ["file", "function", "function"], ["", "a", "b"]),
    ("swift", "import F\nclass A {\n  func a() {}\n  init() {}\n}\nprotocol P { func q() }\n", ["file", "function", "function"], None),
]


@pytest.mark.parametrize("ext,source,kinds,names", CASES)
def test_kinds(ext, source, kinds, names):
    got = chunk_source(ext, source)
    assert [c.kind for c in got][: len(kinds)] == kinds
    if names:
        assert [c.name for c in got] == names
    for c in got:
        assert c.content in source


@pytest.mark.parametrize("ext,source", [("rs", "const A: u8 = 1;\n"), ("cs", "class A {}"), ("py", "def ("), ("js", "function a() {"), ("rs", "")])
def test_whole_file(ext, source):
    (only,) = chunk_or_whole_file(ext, source)
    assert (only.kind, only.content, only.start_line) == ("file", source, 1)

NAMED = [
    ("go", "func F(a int,\n\tb int) (x int,\n\terr error) {\n\treturn\n}\n\nfunc G[T any](x T) T {\n\treturn x\n}\n", [("function", "F"), ("function", "G")]),
    ("go", "type I interface {\n\tM(a int) error\n}\nfunc ext(a int) int\n", [("type", "I")]),
    ("js", "export default class extends Base {\n}\n", [("class", "")]),
    ("js", "export default function () { return 1; }\n", [("function", "")]),
    ("c", "static int\nf(int a,\n  int b)\n{\n  if (a) { return b; }\n  return 0;\n}\nint t[] = { 1, 2 };\n", [("function", "f")]),
    ("c", "typedef struct node {\n  int a;\n} node;\n#define X(a) \\\n  { a }\nvoid g(void) { }\n", [("struct", "node"), ("function", "g")]),
    ("cpp", "namespace n {\ntemplate <typename T>\nclass A : public B {\n public:\n  A() : x(1) { }\n  ~A() { }\n  bool operator==(const A& o) const { return true; }\n};\n}\nvoid A::m() const { }\n", [("function", "A"), ("function", "~A"), ("function", "operator=="), ("function", "m")]),
]


@pytest.mark.parametrize("ext,source,want", NAMED)
def test_names(ext, source, want):
    assert [(c.kind, c.name) for c in chunk_source(ext, source) if c.kind != "file"] == want



#: Ordinary code that heads at line starts, or braces counted in plain text, would get wrong.
HARD = [
    ("rb", "class A\n  def a\n    while x do\n      y\n    end\n  end\n\n  private def b\n    1\n  end\n\n  def c = 1\n\n  def d(x) =\n    x + 1\n\n  class << self\n    def e; end\n  end\nend\n", ["a", "b", "c", "d", "e"]),
    ("rb", "def a\n  x = if y then 1 else 2 end\n  return if x\n  z if x unless y\n  puts(case x when 1 then 2 end)\nend\n\ndef b?(k) (k || 1) end\ndef c=(v)\n  @c = v\nend\ndef ==(o) true end\ndef self.d; begin; 1; end while x; end\n", ["a", "b?", "c=", "==", "d"]),
    ("rb", "def a\n  t = <<~SQL\n    end if class def\n  SQL\n  r = /def \\/ end/ and %w[def end]\n  h = {if: 1, end: 2, class: :end}\n  s = \"#{x.map { |e| \"end #{e}\" }} def\"\n  h.each do |k, v| k.class end\n  [1].each { |q| q }\nend\n=begin\ndef no\n=end\ndef b\n  for i in 1..2 do p i end\n  until x do y end\n  loop do break end\nend\n__END__\ndef no\n", ["a", "b"]),
    ("js", "const f = (a) => a + 1\nfunction g() { return /[{}\"]{/.test(x) }\nlet h = async x => { y }\nexport default class K extends mixin({a: 1}) {\n  x = 5\n  get v() { return `}${ {a: `{`} }` }\n  static async *m({a}, b = {}) {}\n}\nfoo(function () { function inner() {} })\nif (a) { b } else { c }\nfunction last() {}\n", ["f", "g", "h", "v", "m", "inner", "last"]),
    ("js", "const o = {\n  go() { return 1 },\n  stop: 2,\n}\nvar old = () => 1\nconst a = 1, b = 2;\nexport const e = function named() {};\nasync function* gen() {}\n", ["go", "e", "gen"]),
    ("ts", "class A<T extends {a: 1}> {\n  private m(a: {b: string}): void {}\n  n?: {c: number}\n  public get p(): {q: string} { return {q: ''} }\n}\nexport function f(x: {y: number}): {z: string} { return {z: ''} }\nexport interface I<T> extends J { k(): void }\ntype Q = {r: string}\nconst g = <T,>(x: T): T => x\n", ["m", "p", "f", "I", "g"]),
    ("ts", "@Injectable({a: 1})\nexport class S {\n  constructor(private readonly x: X) {}\n}\nabstract class B {\n  abstract n(): void\n  o() {}\n}\n", ["constructor", "o"]),
    ("go", "package p\n\ntype (\n\tA struct {\n\t\tx int\n\t}\n\tB int\n)\n\ntype F func(int) error\n\nfunc (t *T[K]) M(f func() interface{}) (map[string]struct{}, error) {\n\ttype in struct{}\n\treturn nil, nil\n}\n\nfunc G() interface{} {\n\ts := `}{`\n\treturn s\n}\n", ["A", "F", "M", "G"]),
    ("java", "class A { int get() { return 1; } }\nrecord R(int a) { int twice() { return 2 * a; } R { check(a); } }\nenum E { X { int v() { return 1; } }, Y(2); int w() { return 0; } }\n@interface N { int a() default 1; }\n", ["get", "twice", "E"]),
    ("java", "public abstract class A<T extends B> {\n  @Override\n  @Deprecated(since = \"{\")\n  public <K, V> Map<K, List<V>> m(Function<? super K, V> f) throws E, F {\n    Runnable r = () -> { go(); };\n    Object o = new Object() { public String toString() { return \"\"\"\n      } \"\"\"; } };\n    for (int i : new int[] {1, 2}) { }\n    return null;\n  }\n  abstract void n();\n  static { x = 1; }\n  A(int... a) { }\n}\n", ["m", "A"]),
    ("c", "#define BEGIN {\n#define X(a) do { a; \\\n  } while (0)\n#ifdef W\nint f(int a) {\n#else\nint f(void) {\n#endif\n  return 0;\n}\n#if 0\nint no(void) {\n#endif\nchar c = '{';\nstatic const char *g(void) { return \"}\"; }\n", ["f", "g"]),
    ("cpp", "auto s = R\"x(} )\" {)x\";\nint n = 1'000;\ntemplate <class T> struct P { T get() const { return t; } T t; };\nclass Q final : public R<int> { };\n", ["get", "Q"]),
    ("rs", "/* a /* nested } */ b */\npub(crate) async unsafe fn a<'x>(s: &'x str) -> [u8; 2] where T: X { let r = r#\"}\"#; let c = '{'; match s { _ => {} } }\n#[test]\nfn b() -> impl Fn() -> u8 { || 1 }\ntrait T { fn sig(&self); fn dflt(&self) { } }\nmod m { pub const fn c() {} macro_rules! q { () => { fn no } } }\nunsafe impl<T> Send for W<T> {}\n", ["a", "b", "dflt", "c", ""]),
    ("swift", "public final class A: B {\n  override func a<T>(_ x: T) -> [T] where T: C { let s = \"\\(x.map { \"}\" })\"; return [] }\n  class func b() {}\n  static func == (l: A, r: A) -> Bool { true }\n  convenience init?(x: Int = { 1 }()) { self.init() }\n  deinit { }\n  var v: Int { 1 }\n}\nextension A { @objc private func c() {} }\nprotocol P { func q() }\nenum E { case one }\nlet t = #\"}\"#\nfunc d() async throws {}\n", ["a", "b", "==", "", "", "c", "P", "E", "d"]),
]


@pytest.mark.parametrize("ext,source,want", HARD)
def test_ordinary_code(ext, source, want):
    got = [c for c in chunk_source(ext, source) if c.kind != "file"]
    assert [c.name for c in got] == want
    for c in got:
        assert c.content in source and source.split("\n")[c.start_line - 1].find(c.content.split("\n")[0]) >= 0


def test_ends_of_declarations():
    got = {c.name: c.content for e, s, _ in HARD[3:5] for c in chunk_source(e, s)}
    assert got["f"] == "const f = (a) => a + 1" and got["h"] == "let h = async x => { y }" and got["e"] == "export const e = function named() {};"
    got = {c.name: c.content for c in chunk_source("rb", HARD[0][1])}
    assert got["c"] == "def c = 1" and got["d"] == "def d(x) =\n    x + 1" and got["e"] == "def e; end"
    assert next(c for c in chunk_source("go", HARD[7][1]) if c.name == "A").content.endswith("B int\n)")


def test_records_and_annotations_are_no_chunks():
    kinds = [(c.kind, c.name) for c in chunk_source("java", "record R(int a) { }\n@interface N { }\nclass A { }\n") if c.kind != "file"]
    assert kinds == [("class", "A")]


@pytest.mark.parametrize("ext,line", [("c", "some words in a row\n"), ("cpp", "f(a) words\n"), ("c", "{1, 2},\n"), ("rs", "fn f() {}\n")])
def test_long_files_take_linear_time(ext, line):
    began = time.process_time()
    chunk_or_whole_file(ext, line * 40_000)
    assert time.process_time() - began < 10
