"""Symbol scanners, language by language."""

from papyra.operators.code import symbols
from papyra.operators.markdown import block_sections


def found(path, text):
    src, got = symbols(text, path)
    return [(s.kind, s.name, s.start + 1, s.end + 1, s.exported, got[s.parent].name if s.parent is not None else None) for s in got]


def test_typescript():
    text = """import { a } from 'x';
import b from "y";

export abstract class Repo<T> extends Base {
  private items: Map<string, T> = new Map();
  constructor(private n: number) {
    super();
  }
  async get(id: string): Promise<T> {
    if (id) { return 1; }
  }
  abstract size(): number;
}
export interface Shape {
  readonly name: string;
  area(): number;
}
type Id = string | number;
export enum Color { Red, Green }
export async function load(
  a: string,
): Promise<void> {
}
const add = (a: number, b: number) => a + b;
export const LIMITS = {
  max: 10,
};
export const run = async () => {
  go();
};
"""
    got = found("a.ts", text)
    assert [(k, n) for k, n, *_ in got] == [
        ("import", "imports"), ("class", "Repo"), ("property", "items"), ("method", "constructor"), ("method", "get"), ("method", "size"), ("interface", "Shape"), ("property", "name"), ("method", "area"),
        ("type", "Id"), ("enum", "Color"), ("function", "load"), ("function", "add"), ("variable", "LIMITS"), ("function", "run"),
    ]
    assert got[0][2:4] == (1, 2) and got[1][2:5] == (4, 13, True) and got[4][2:4] == (9, 11) and got[11][2:4] == (20, 23) and got[13][2:4] == (25, 27)


def test_python():
    text = '''"""doc"""
from a import (
    b,
    c,
)
import d

@deco(1)
class A(Base):
    x = 1

    @property
    def p(self):
        return 1
# comment

    async def q(self,
                z):
        pass

def _f():
    pass

LIST = [
    1,
]
'''
    got = found("m.py", text)
    assert [(k, n, e) for k, n, _, _, e, _ in got] == [("import", "imports", False), ("class", "A", True), ("method", "p", True), ("method", "q", True), ("function", "_f", False), ("variable", "LIST", True)]
    assert got[0][2:4] == (2, 6) and got[1][2:4] == (8, 19) and got[2][2:4] == (12, 14) and got[5][2:4] == (24, 26)


def test_java():
    text = """package a;
import b.C;

/** doc */
@Entity
@Table(name = "x")
public class Account extends Base<String> {
    private int n = compute(1);
    @Override
    public String name() {
        if (n > 1) { return call(n); }
        return "x";
    }
    protected Account(int n) {
        this.n = n;
    }
    abstract void later(int a);
    static class Inner { void hidden() {} }
}
enum Kind { A, B }
"""
    got = found("A.java", text)
    assert [(k, n, p) for k, n, *_, p in got] == [
        ("import", "imports", None), ("class", "Account", None), ("method", "name", "Account"), ("method", "Account", "Account"), ("method", "later", "Account"), ("class", "Inner", "Account"), ("enum", "Kind", None)
    ]
    assert got[1][2:5] == (5, 19, True) and got[2][2:5] == (9, 13, True)


def test_go_and_rust():
    go = "package m\n\nfunc (s *Srv[T]) Run() error {\n}\n\ntype Srv[T any] struct {\n}\ntype ID string\n\nconst (\n\tA = 1\n)\nvar x = 2\nfunc New(a int) *Srv {\n}\n"
    assert [(k, n, e, p) for k, n, _, _, e, p in found("m.go", go)] == [
        ("class", "Srv", True, None), ("type", "ID", True, None), ("method", "Run", True, "Srv"), ("variable", "constants", False, None), ("variable", "x", False, None), ("function", "New", True, None)
    ]
    rust = "pub struct P(i32);\nenum E {\n A,\n}\npub trait T {\n fn t(&self);\n}\nimpl<'a> T for P {\n    fn t(&self) {\n    }\n}\nimpl P {\n    pub async fn new() -> Self {\n    }\n}\npub(crate) fn f() {\n}\nconst N: u8 = 1;\ntype X = u8;\n"
    assert [(k, n, e, p) for k, n, _, _, e, p in found("m.rs", rust)] == [
        ("class", "P", True, None), ("enum", "E", False, None), ("interface", "T", True, None), ("method", "t", False, "P"), ("method", "new", True, "P"), ("function", "f", True, None),
        ("variable", "N", False, None), ("type", "X", False, None),
    ]


def test_indented_go_and_rust_items():
    rust = "mod m {\n    // struct No;\n    pub struct P {\n        n: u8,\n    }\n    impl P {\n        pub fn new() -> u8 {\n            1\n        }\n    }\n    fn f() {\n    }\n}\n"
    assert [(k, n, s, e, x, p) for k, n, s, e, x, p in found("m.rs", rust)] == [("class", "P", 3, 5, True, None), ("method", "new", 7, 9, True, "P"), ("function", "f", 11, 12, False, None)]
    go = "  type Set[K comparable, V []int] struct {\n  }\n\ttype Row [4]int\n type F = func(a int) struct{}\n  func (s *Set[K, V]) Add(k K) {\n  }\n func (Row) Len() int {\n }\n  func Map[A any, B any](a []A) []B {\n  }\nimport (\n\t\"func x(\"\n)\n"
    assert [(k, n, p) for k, n, _, _, _, p in found("m.go", go)] == [("class", "Set", None), ("type", "Row", None), ("type", "F", None), ("method", "Add", "Set"), ("method", "Len", "Row"), ("function", "Map", None)]


def test_arrows_and_python_heads():
    ts = "const a = <T,>(x: T): T => x;\nexport const b: (n: number) => void = async n => {\n};\nexport const c = a >= 1;\nlet d = (1 + 2);\n"
    assert [(k, n) for k, n, *_ in found("a.mts", ts)] == [("function", "a"), ("function", "b"), ("variable", "c")]
    py = "def f(a: dict = {1: 2},\n" + "".join(f"      b{i}: int = {i},\n" for i in range(12)) + "      ) -> dict[str, int]:\n    return a\n"
    src, got = symbols(py, "m.py")
    assert got[0].signature.startswith("def f(a: dict = {1: 2}, b0: int = 0,") and got[0].signature.endswith(") -> dict[str, int]") and got[0].end == 14


def test_other_languages():
    c = '#include <a.h>\n#include "b.h"\n\nstruct Point {\n  int x;\n};\nenum Kind { A };\nint Ns::Cls::run(int a) {\n  return a;\n}\nstatic int help(void) {\n  return 1;\n}\nint proto(int a);\n'
    assert [(k, n, e) for k, n, _, _, e, _ in found("a.cpp", c)] == [("import", "imports", False), ("class", "Point", False), ("enum", "Kind", False), ("function", "Ns::Cls::run", True), ("function", "help", False), ("function", "proto", True)]
    ruby = "require 'x'\n\nclass A\n  def b(c)\n    if c\n      1\n    end\n  end\nend\n\ndef top\nend\n"
    assert [(k, n, s, e) for k, n, s, e, *_ in found("a.rb", ruby)] == [("import", "imports", 1, 1), ("class", "A", 3, 9), ("method", "b", 4, 8), ("function", "top", 11, 12)]
    assert [(k, n) for k, n, *_ in found("a.sh", "source x\nrun() {\n  :\n}\n")] == [("import", "imports"), ("function", "run")]
    assert [(k, n) for k, n, *_ in found("a.cs", "using X;\nclass A {\n  public int Run(int a) {\n    return 1;\n  }\n}\n")] == [("import", "imports"), ("class", "A"), ("method", "Run")]
    assert found("x.lua", "") == []


def test_markdown_blocks():
    text = "lost\n# One #\npara one\nstill\n\n```sh\n# not a heading\n```\n* a\n* b\n\nTwo\n===\n> q1\n> q2\n"
    assert block_sections(text) == [(1, "One", "para one still\n[code:sh] # not a heading\n- a\n- b", 2, 11), (1, "Two", "> q1 q2", 12, 16)]
    assert block_sections("no heading") == []


def test_members_of_classes_and_interfaces_by_words():
    text = """export abstract class Box<T> extends Base {
  #size = 0;
  static readonly LIMIT: number = 10;
  cb: () => void;
  handler = (e: Event) => {
    return e;
  };
  get;
  declare name?: string;
  constructor(private readonly inner: T) {
    super();
  }
  get value(): T { return this.inner; }
  set value(v: T) {
    if (v) { this.inner = v; }
  }
  get(key: string) { return key; }
  async *items<K>(from: K): AsyncGenerator<K> {
    yield from;
  }
  #hidden() {}
  protected abstract area(): number;
  // note(x): y
  @Input() label: string;
  static { Box.LIMIT; }
}
interface Shape {
  readonly id: number;
  name?: string;
  get(key: string): string;
  map<U>(f: (x: number) => U): U[];
  [key: string]: unknown;
  nested: {
    inner: number;
  };
}
"""
    got = [(r[0], r[1]) for r in found("box.ts", text)]
    assert got == [
        ("class", "Box"), ("property", "#size"), ("property", "LIMIT"), ("property", "cb"), ("property", "handler"), ("property", "get"), ("property", "name"), ("method", "constructor"), ("method", "value"), ("method", "value"),
        ("method", "get"), ("method", "items"), ("method", "#hidden"), ("method", "area"), ("interface", "Shape"), ("property", "id"), ("property", "name"), ("method", "get"), ("method", "map"), ("property", "nested"),
    ]
