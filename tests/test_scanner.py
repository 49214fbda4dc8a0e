"""Units found by the token scan: owners and names, in three languages."""

import timeit

import pytest

from lodestone.functions import scanner

TQ, BACK = '"""', "\\"


def names(language, source):
    found = scanner.units_of(source, language)
    return [(m["class_name"], m["name"]) for m in found["methods"]], [(c["class_kind"], c["name"], c["count"]) for c in found["classes"]]


TEXTS = {
    "python": (f"s = 'def a(): {{'\n# def b():\ndef c(x=')'):\n    {TQ}def d():\n    {TQ}\ndef e(): return '''\ndef f(): 1'''\n",
               [(None, "c"), (None, "e")], []),
    "scala": (f"object A {{ /* def x = {{ */ val s = {TQ} }} \" def y = {{ {TQ}; def z = '}}' // }}\n def w = \"{BACK}\"}}\" }}",
              [("A", "z"), ("A", "w")], [("object", "A", 2)]),
    "java": (f"class A {{ char c = '}}'; /* void x() {{ */ String s = \"{BACK}\"{{\"; String t = {TQ}\n }} \"q\" void y() {{}} {TQ}; int z() {{ return '{{'; }} }}",
             [("A", "z")], [("class", "A", 1)]),
}


@pytest.mark.parametrize("language", TEXTS)
def test_strings_and_comments_hold_no_code(language):
    source, *want = TEXTS[language]
    assert list(names(language, source)) == want


SHARED = {
    "scala one line": ("class A { def a = 1; def b = { 2 }; def c(): Unit = {}; class B { def d = 3 } }; trait T\nobject O extends T { def e = 4 }",
                       [("A", "a"), ("A", "b"), ("A", "c"), ("A", "d"), ("O", "e")], [("class", "A", 4), ("trait", "T", 0), ("object", "O", 1)]),
    "scala many lines": ("final\nclass\n  A[T <: B](\n  a: Int) {\n  def\n    x[U](\n  u: U)\n  : Int =\n    u match {\n      case 1 => 2\n    }\n"
                         "  def + (o: A): A = o\n  def ::(o: A) = o\n}", [("A", "x"), ("A", "+"), ("A", "::")], [("class", "A", 3)]),
    "java many lines": ("class\n  A\n{\n  int\n  a\n  (\n  )\n  { }\n  A() { super(); } int b() throws X, Y { if (c) { d(); } else { e(); } }\n}",
                        [("A", "a"), ("A", "A"), ("A", "b")], [("class", "A", 3)]),
}
MARKED = {
    "python": ("@a.b(c)\ndef x(): pass\n@d\nclass Y:\n  def z(self): pass\nclass W:\n  @e\n  @f()\n  def v(self):\n    @g\n    def u(): pass\n",
               [("W", "v")], [("class", "W", 1)]),
    "java": ('@A(x = {1, 2}) @B public class C { @D("}") @Override public <T extends X> Map<T, int[]> e(@F int g) { return null; } @interface H { int i(); } }',
             [("C", "e"), ("C", "i")], [("class", "C", 2)]),
}
INNER = {
    "java": ("enum E { A(1) { void f() { } }, B { int g() { return 1; } }; private final int x; E(int x) { this.x = x; } static { foo(1); } "
             "Object o = bar(() -> { baz(2); new Q() { }; }); }", [("E", "f"), ("E", "g"), ("E", "E")], [("enum", "E", 3)]),
    "scala": ("object A {\n  val r = new R { def run() = { 1 } }\n  lazy val q = {\n    foo { x => x }\n  }\n  def f =\n    if (a) b\n    else c\n\n"
              "  def g = a\n    .b { c }\n    .d\n}\nval top = new R { def no = 1 }\ndef yes = 1",
              [("A", "run"), ("A", "f"), ("A", "g"), (None, "yes")], [("object", "A", 3)]),
    "python": ("if x:\n  def a(): pass\nclass B:\n  if y:\n    def c(self): pass\n  class D:\n    def e(self): pass\nasync def f(): pass\n",
               [("B", "c"), ("B", "e"), (None, "f")], [("class", "B", 2)]),
    "scala by indent": ("class A(x: Int):\n  def a = 1\n  def b: Int =\n    val y = 2\n    y\nend A\nobject B:\n  def c = 3\n",
                        [("A", "a"), ("A", "b"), ("B", "c")], [("class", "A", 2), ("object", "B", 1)]),
}
BROKEN = {
    "python": ("def a(x:\n  y", [(None, "a")], []), "java": ("class A { void b() { c(", [("A", "b")], [("class", "A", 1)]),
    "scala": ('object A { def b = { "c', [("A", "b")], [("object", "A", 1)]), "java stray": ("} ) class A { void b() { } }", [("A", "b")], [("class", "A", 1)]),
    "scala empty": ("", [], []), "python blank": ("\n\n", [], []),
}


@pytest.mark.parametrize("cases", [SHARED, MARKED, INNER, BROKEN], ids=["shared lines", "marks", "inner", "broken"])
def test_units(cases):
    for name, (source, *want) in cases.items():
        assert list(names(name.split()[0], source)) == want, name


def test_imports_are_whole_statements():
    found = lambda language, source: [i["content"] for i in scanner.units_of(source, language)["imports"]]
    assert found("python", f"import a; import b as c\nfrom d import (\n  e,  # f\n  g)\n\nimport h {BACK}\n  , i\n\ndef j():\n  import k\n") \
        == ["import a", "import b as c", "from d import (\n  e,  # f\n  g)", f"import h {BACK}\n  , i"]
    assert found("scala", "package a\nimport b.{\n  C => D,\n  _\n}\nimport e._ // f\nobject G { import h.I }") \
        == ["package a", "import b.{\n  C => D,\n  _\n}", "import e._"]
    assert found("java", "package a.b ;import\n c.D;\nimport static e.F.*;") == ["package a.b ;", "import\n c.D;", "import static e.F.*;"]


@pytest.mark.parametrize("language, one", [
    ("python", "class C{0}:\n  def f{0}(a):\n    return '{{'\n"), ("scala", 'object O{0} {{ def f(x: Int) = {{ x }}; def g = "}}" }}\n'),
    ("java", "class A{0} {{ int f() {{ return 1; }} }}\n")])
def test_scan_grows_with_the_text(language, one):
    def seconds(n):
        source = "".join(one.format(i) for i in range(n))
        return min(timeit.repeat(lambda: scanner.units_of(source, language), number=1, repeat=3))
    assert seconds(16_000) < 2.5 * 8 * seconds(2_000)
