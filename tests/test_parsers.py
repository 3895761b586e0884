"""Parsers on sources written for these tests."""

import pytest

from structgraph.functions.lexers import tokens
from structgraph.sources.parse import parse
from tests.samples import PROJECT


def names(xs):
    return [x["name"] for x in xs]


def test_python():
    p = parse("config.py", PROJECT["shop/config.py"])
    assert p["parse_error"] is None and names(p["functions"]) == ["load", "check"]
    load = p["functions"][0]
    assert (load["start_line"], load["end_line"], load["docstring"], load["parameters"]) == (10, 13, "Read settings.", ["path"])
    assert load["calls"] == ["Path(path).read_text", "Path"]
    assert [(i["module"], i["names"]) for i in p["imports"]] == [(None, ["os"]), ("pathlib", ["Path"])]
    assert [(v["name"], v["start_line"]) for v in p["variables"]] == [("LIMIT", 6), ("PLACE", 7)]
    m = parse("models.py", PROJECT["shop/models.py"])
    cart = m["classes"][1]
    assert (cart["name"], cart["bases"], cart["docstring"]) == ("Cart", ["Base"], "Things to buy.")
    assert cart["methods"][0]["decorators"] == ["property"] and cart["methods"][0]["parameters"] == ["self", "*args", "**more"]
    assert m["classes"][2]["methods"][0]["calls"] == ["super().__init__", "super"]


def test_python_forms():
    p = parse("x.py", 'import numpy as np, os.path\nfrom ..a import (b as c, d)\nfrom z import *\n@app.get("/x")\nasync def f(a, /, b, *, c=1): r"""raw"""\nif True:\n    def hidden(): pass\nx = y = 1\nx += 2\n')
    assert [(i["module"], i["names"]) for i in p["imports"]] == [(None, ["numpy", "os.path"]), ("..a", ["b", "d"]), ("z", [])]
    f = p["functions"][0]
    assert names(p["functions"]) == ["f"] and f["decorators"] == ["app.get"] and f["start_line"] == 5 and f["docstring"] is None and f["parameters"] == ["a", "b", "c"]
    assert names(p["variables"]) == ["x"]


def test_broken_python_still_tells_something():
    p = parse("x.py", "import os\ndef f(:\n  pass\nclass A(B):\n")
    assert p["parse_error"] and names(p["functions"]) == ["f"] and names(p["classes"]) == ["A"]


TS = """import Def, { a as b, c } from './m';
import * as ns from "x";
const fs = require('fs');
@sealed()
export class Box<T> extends Base<T> implements One, Two<string> {
  private readonly n: number = 1;
  constructor(private x: string, ...rest: string[]) { super(x); }
  @log
  async get(key: string, opt?: { a: number }): Promise<T | null> {
    const y = new Thing(key);
    return this.load(key)?.then((v) => fetch(v));
  }
  arrow = (e: Event): void => { go(e); };
}
interface Shape extends Base { area(): number; name?: string }
export const run = async (p, { q }) => {
  if (p) { helper(p); }
};
export default function start<T>(a: T, b = 2): void { run(a) }
let counter = 0;
total = 5
function* gen() {}
"""


def test_typescript():
    p = parse("x.ts", TS)
    assert p["parse_error"] is None
    assert [(i["module"], i["names"], i["aliases"]) for i in p["imports"]] == [("./m", ["Def", "a", "c"], {"b": "a"}), ("x", ["ns"], {}), ("fs", ["fs"], {})]
    box, shape = p["classes"]
    assert (box["name"], box["bases"], box["decorators"], box["start_line"], box["end_line"]) == ("Box", ["Base", "One", "Two"], ["sealed"], 5, 14)
    assert [(m["name"], m["parameters"], m["calls"]) for m in box["methods"]] == [("constructor", ["x", "...rest"], []), ("get", ["key", "opt"], ["this.load(key)?.then", "this.load", "fetch"]), ("arrow", ["e"], ["go"])]
    assert (shape["name"], shape["bases"], names(shape["methods"])) == ("Shape", ["Base"], ["area", "name"])
    assert [(f["name"], f["parameters"], f["calls"]) for f in p["functions"]] == [("run", ["p"], ["helper"]), ("start", ["a", "b"], ["run"]), ("gen", [], [])]
    assert names(p["variables"]) == ["counter", "total"]


def test_javascript_literals_do_not_confuse():
    p = parse("x.js", "const re = /[}\"']/g;\nconst t = `a ${f({x: 1})} }`;\nfunction g() { return `${h()}`; }\n// function no() {}\n")
    assert names(p["functions"]) == ["g"] and p["functions"][0]["calls"] == ["h"] and names(p["variables"]) == ["re", "t"]


JAVA = """package a.b;
import java.util.List;
import static x.Y.*;

@Entity(name = "d")
public class Dog<T extends Comparable<T>> extends Animal implements Pet, Named {
    private int age = compute();
    public Dog(String name, int... ages) { super(name); this.age = new Helper<>(1).get(); }
    @Override
    public <R> R speak(final Map<String, List<R>> m) throws IOException { System.out.println(m); helper(); Runnable r = () -> go(); return null; }
    static class Inner { void no() {} }
    abstract int f();
}
enum Color { RED(1) { void x() {} }, BLUE; int code() { return 1; } }
interface Speak extends A, B { void say(); }
"""


def test_java():
    p = parse("Dog.java", JAVA)
    assert p["parse_error"] is None
    assert [(i["module"], i["names"]) for i in p["imports"]] == [("java.util", ["List"]), ("x.Y", ["*"])]
    dog, color, speak = p["classes"]
    assert (dog["bases"], dog["decorators"]) == (["Animal", "Pet", "Named"], ["Entity"])
    assert [(m["name"], m["parameters"], m["decorators"]) for m in dog["methods"]] == [("Dog", ["name", "ages"], []), ("speak", ["m"], ["Override"]), ("f", [], [])]
    assert dog["methods"][1]["calls"] == ["System.out.println", "helper", "go"]
    assert names(color["methods"]) == ["code"] and (speak["bases"], names(speak["methods"])) == (["A", "B"], ["say"])


CPP = """#include <vector>
#include "a/b.h"
#define X(a) { a
namespace n {
class Circle : public Shape, private virtual Other {
public:
    Circle(double r) : r_(r) {}
    double area() const override { return std::sqrt(r_) * pi(); }
    void later();
};
int total(Shape* shapes[], int count) { int s = 0; for (;;) s += shapes[0]->area(); return s; }
}
static int limit = 3;
int plain;
char *text(const char *p, int n = 2) { return dup(p); }
void n::Other::run() { go(); }
"""


def test_cpp_and_c():
    p = parse("x.cpp", CPP)
    assert p["parse_error"] is None and [i["module"] for i in p["imports"]] == ["vector", "a/b.h"]
    assert [(c["name"], c["bases"], names(c["methods"])) for c in p["classes"]] == [("Circle", ["Shape", "Other"], ["Circle", "area"])]
    assert p["classes"][0]["methods"][1]["calls"] == ["std::sqrt", "pi"]
    assert [(f["name"], f["parameters"], f["calls"]) for f in p["functions"]] == [("total", ["count"], ["shapes[0]->area"]), ("text", ["p", "n"], ["dup"]), ("n::Other::run", [], ["go"])]
    assert names(p["variables"]) == ["limit", "plain"]
    c = parse("m.c", "typedef struct { int x; } Point;\nstruct Color { int r; };\nint n = 0;\nint add(int a, int *b) {\n  return printf(\"%d\", a);\n}\n")
    assert names(c["classes"]) == ["Point", "Color"] and names(c["variables"]) == ["n"] and c["functions"][0]["end_line"] == 6


def test_markup_and_configuration():
    h = parse("i.html", '<html><head><link rel="stylesheet" href="s.css"><link rel="icon" href="i.png">\n<script src="a.js"></script></head><body id="top"></body></html>')
    assert [(i["module"], i["start_line"]) for i in h["imports"]] == [("s.css", 1), ("a.js", 2)] and names(h["variables"]) == ["#top"]
    c = parse("s.css", '@import "base.css";\n@import url("t.css");\nbody, p > a {\n  margin: 0;\n}\n.btn:hover { color: red }\n@media print { .no { color: red } }\n')
    assert [i["module"] for i in c["imports"]] == ["base.css", "t.css"] and [(x["name"], x["start_line"], x["end_line"]) for x in c["classes"]] == [("body, p > a", 3, 5), (".btn:hover", 6, 6)]
    j = parse("c.json", '{"a": 1,\n "db": {"host": "x", "o": {"ssl": true}},\n "l": [{"no": 1}]}')
    assert names(j["classes"]) == ["db", "db.o"] and sorted(names(j["variables"])) == ["a", "db.host", "db.o.ssl", "l"]
    y = parse("c.yaml", "a: 1\ndb:\n  host: x\n  o:\n    ssl: true\nl:\n  - no: 1\nf: {g: 1}\n")
    assert names(y["classes"]) == ["db", "db.o"] and sorted(names(y["variables"])) == ["a", "db.host", "db.o.ssl", "f", "l"]
    t = parse("c.toml", 'top = 1\n[db]\nhost = "x" # c\nlist = [\n  1,\n]\n[db.o]\nssl = true\n[[many]]\nno = 1\n')
    assert names(t["classes"]) == ["db", "db.o"] and names(t["variables"]) == ["top", "db.host", "db.list", "db.o.ssl"]


@pytest.mark.parametrize("path", ["x.py", "x.js", "x.ts", "x.java", "x.c", "x.cpp", "x.html", "x.css", "x.json", "x.yaml", "x.toml", "x.unknown", "noextension", ""])
@pytest.mark.parametrize("text", [None, "", "\n", "{", "}", "'", '"""', "/*", "((((", "class", "def", "import", "\x00\ufffd", "=" * 50, "a" * 2000, "[" * 300])
def test_no_text_ends_the_run(path, text):
    p = parse(path, text)
    assert p["path"] == path and isinstance(p["functions"], list)


def test_lexers_cover_every_character():
    for lang in ("py", "js", "ts", "java", "c", "cpp", "css", "json", "toml"):
        text = "a \u00e9 \u4e2d 'x' \"y\" 1.5e3 /* c */ // d\n# e\n`t ${z} u` <<>> $ \\ \x07"
        toks = tokens(text, lang, comments=True)
        assert toks and all(text[p:].startswith(t[:1]) or k == "err" or t == "+" for k, t, p in toks)
