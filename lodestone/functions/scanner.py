"""Units of one source file, in one pass over its tokens.

Strings and comments are single tokens, so that nothing inside them counts. Scala and Java
keep a stack of open brackets, each with the statement that stands in it; Python goes by
logical lines and their indent. What a unit holds is not looked into again, so the work
grows with the tokens, whatever the number of units.

A result is ``imports`` (content, start), ``classes`` (class_kind, name, start, end, and
which ``methods`` are its own: first, count) and ``methods`` (class_name, name, content,
start, end). Lines count from 1.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

FIELDS = {
    "imports": {"content": "string", "start": "int"},
    "classes": {"class_kind": "string", "name": "string", "start": "int", "end": "int", "first": "int", "count": "int"},
    "methods": {"class_name": "string", "name": "string", "content": "string", "start": "int", "end": "int"},
}
UNITS = "struct<" + ",".join(
    f"{part}:array<struct<{','.join(f'{n}:{kind}' for n, kind in columns.items())}>>" for part, columns in FIELDS.items()) + ">"

_REST = r"|(?P<line>\n)|(?P<word>[\w$]+|`[^`\n]+`)|(?P<mark>\S)"
_C_NOTES = r"|(?P<note>//[^\n]*|/\*.*?(?:\*/|\Z))"
_CHAR = r"'(?:\\[^\n']+|\\'|[^'\\\n])'"
TOKENS = {
    "python": re.compile(
        r"(?s:(?P<text>(?i:[bruf]{0,2})(?:\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\.|[^\\])*?(?:'''|\Z)"
        r"|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?))|(?P<note>#[^\n]*|\\\n)" + _REST + ")"),
    "scala": re.compile(
        r"(?s:(?P<text>\"\"\".*?(?:\"{3,}|\Z)|\"(?:\\.|[^\"\\\n])*\"?|" + _CHAR + ")" + _C_NOTES + _REST + ")"),
    "java": re.compile(
        r"(?s:(?P<text>\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|\"(?:\\.|[^\"\\\n])*\"?|" + _CHAR + ")" + _C_NOTES + _REST + ")"),
}
_CLOSES = {"(": ")", "[": "]", "{": "}"}
_SCALA_MODIFIERS = frozenset("private protected final override implicit lazy sealed abstract inline transparent opaque open infix case".split())
_JAVA_MODIFIERS = frozenset("public protected private static final abstract synchronized native default strictfp sealed".split())
_JAVA_STATEMENTS = frozenset("return new else throw if for while switch catch try case do assert super this yield record import package".split())
_SCALA_KINDS, _JAVA_KINDS = ("class", "object", "trait"), ("class", "interface", "enum")
# a statement goes on over a line end after these, and before those
_SCALA_AFTER = frozenset("= , . : + - * / & | < > ? % ^ ! ~ @ extends with else yield match do then catch finally if while for new throw derives".split())
_SCALA_BEFORE = frozenset(". , ) ] = + * / & | < > ? % ^ : extends with else yield match do then catch finally derives".split())
_SCALA_NAME = re.compile(r"\s*(`[^`\n]+`|[^\s(\[:={;]+|[^\s\w(\[{;]+)")


@dataclass
class _Units:
    source: str
    imports: list = field(default_factory=list)
    classes: list = field(default_factory=list)
    methods: list = field(default_factory=list)

    def __post_init__(self):
        self.breaks = [m.start() for m in re.finditer("\n", self.source)]

    def line(self, at: int) -> int:
        return bisect_right(self.breaks, at - 1) + 1 if at else 1

    def column(self, at: int) -> int:
        return at - self.source.rfind("\n", 0, at) - 1

    def imported(self, start: int, end: int) -> None:
        self.imports.append({"content": self.source[start:end], "start": self.line(start)})

    def opened(self, kind: str, name: str, start: int) -> dict:
        unit = {"class_kind": kind, "name": name, "start": self.line(start), "first": len(self.methods) + 1}
        self.classes.append(unit)
        return unit

    def closed(self, unit: dict, end: int) -> None:
        unit["end"], unit["count"] = self.line(end - 1), len(self.methods) + 1 - unit["first"]

    def method(self, owner: str | None, name: str, start: int, end: int) -> None:
        self.methods.append({"class_name": owner, "name": name, "content": self.source[start:end],
                             "start": self.line(start), "end": self.line(end - 1)})

    def result(self) -> dict:
        return {"imports": self.imports, "classes": self.classes, "methods": self.methods}


def _python(out: _Units) -> None:
    """Top-level functions and classes and the functions of these; a decorated top-level one is left out."""
    cls = method = None  # (indent, class) and (indent, name, start) that are open
    decorated, depth, last, statement = False, 0, 0, []

    def leave(indent: int) -> None:
        nonlocal cls, method
        if method and indent <= method[0]:
            out.method(cls and cls[1]["name"], method[1], method[2], last)
            method = None
        if cls and indent <= cls[0]:
            out.closed(cls[1], last)
            cls = None

    def logical(tokens: list) -> None:
        nonlocal cls, method, decorated, last
        words = [t[0] for t in tokens[:3]]
        start, indent = tokens[0][1], out.column(tokens[0][1])
        leave(indent)
        head = words[1:] if words[0] == "async" else words
        named = len(head) > 1 and head[0] in ("class", "def") and re.match(r"[^\W\d]", head[1])
        if not method:
            if indent == 0 and words[0] in ("import", "from") and "__future__" not in words:
                at = 0
                for k in [*(i for i, t in enumerate(tokens) if t[0] == ";"), len(tokens)]:
                    if k > at and tokens[at][0] in ("import", "from"):
                        out.imported(tokens[at][1], tokens[k - 1][2])
                    at = k + 1
            elif named and (cls or indent == 0) and not (decorated and indent == 0):
                if head[0] == "def":
                    method = (indent, head[1], start)
                elif indent == 0:
                    cls = (indent, out.opened("class", head[1], start))
        if indent == 0:
            decorated = words[0] == "@"
        last = tokens[-1][2]

    for token in TOKENS["python"].finditer(out.source):
        kind, text = token.lastgroup, token.group()
        if kind == "line":
            if not depth and statement:
                logical(statement)
                statement = []
        elif kind != "note":
            depth = max(0, depth + (text in "([{") - (text in ")]}")) if kind == "mark" else depth
            statement.append((text, token.start(), token.end()))
    if statement:
        logical(statement)
    leave(-1)


@dataclass
class _Open:
    """An open bracket, or a class body by indent, and the statement that stands in it."""
    close: str
    kind: str  # root, class, inner, paren, dead
    name: str | None = None
    unit: dict | None = None
    indent: int = -1
    indent_of_start: int = 0
    start: int | None = None
    end: int = 0
    head: list = field(default_factory=list)
    # of a Scala definition: its name
    defined: str | None = None

    def clear(self) -> None:
        self.start, self.head, self.defined = None, [], None


def _bare(head: list[str]) -> list[str]:
    """Head tokens without annotations and their arguments."""
    out, i = [], 0
    while i < len(head):
        if head[i] != "@":
            out.append(head[i])
            i += 1
            continue
        i += 2
        while i + 1 < len(head) and head[i] == ".":
            i += 2
        i += i < len(head) and head[i] == "()"
    return out


def _kind_and_name(head: list[str], kinds, modifiers) -> tuple[str, str] | None:
    for k, word in enumerate(head):
        if word in kinds and k + 1 < len(head) and re.match(r"[\w$`]", head[k + 1]):
            return word, head[k + 1]
        if word not in modifiers and word != "[]":
            return None
    return None


def _java_method(head: list[str], place: _Open, body: bool) -> str | None:
    """The name in a method's or constructor's header."""
    if "()" not in head or head[0] in _JAVA_STATEMENTS:
        return None
    at = head.index("()")
    name = head[at - 1] if at else ""
    before = head[:at - 1]
    if not re.match(r"[\w$]+\Z", name) or name in _JAVA_STATEMENTS or "=" in before or "record" in before[-1:]:
        return None
    typed = before and before[-1] not in _JAVA_MODIFIERS | {"."} and re.match(r"[\w$]+\Z|>\Z|\[\]\Z", before[-1])
    if typed and not (before[-1] == ">" and before[0] == "<"):
        return name
    return name if body and place.name == name else None


class _Braces:
    """The scan of Scala and Java."""

    def __init__(self, out: _Units, scala: bool):
        self.out, self.scala, self.stack = out, scala, [_Open("", "root")]

    def owner(self) -> dict | None:
        return next((o.unit for o in self.stack if o.unit), None)

    def ended(self, place: _Open, end: int) -> None:
        """A statement ends: what it was is known now."""
        head = _bare(place.head)
        if place.start is not None and head:
            owner = self.owner()
            if place.kind == "root" and head[0] in ("import", "package"):
                self.out.imported(place.start, end)
            elif place.defined:
                self.out.method(owner and owner["name"], place.defined, place.start, end)
            elif place.kind == "root" and self.scala and (found := _kind_and_name(head, _SCALA_KINDS, _SCALA_MODIFIERS)):
                self.out.closed(self.out.opened(*found, place.start), end)
            elif not self.scala and owner and place.kind != "dead" and (name := _java_method(head, place, False)):
                self.out.method(owner["name"], name, place.start, end)
        place.clear()

    def opens(self, mark: str) -> _Open:
        place = self.stack[-1]
        if mark != "{":
            return _Open(_CLOSES[mark], "dead" if place.kind == "dead" or place.defined else "paren")
        head = _bare(place.head)
        if place.kind == "dead" or place.defined:
            return _Open("}", "dead")
        kinds, modifiers = (_SCALA_KINDS, _SCALA_MODIFIERS) if self.scala else (_JAVA_KINDS, _JAVA_MODIFIERS)
        if place.kind != "paren" and (found := _kind_and_name(head, kinds, modifiers)):
            if place.kind == "root":
                return _Open("}", "class", found[1], self.out.opened(*found, place.start))
            return _Open("}", "inner", found[1])
        if not self.owner():
            return _Open("}", "dead")
        if not self.scala and place.kind != "paren" and head and (name := _java_method(head, place, True)):
            place.defined = name
            return _Open("}", "dead")
        return _Open("}", "inner")

    def close(self, end: int) -> None:
        done = self.stack[-1]
        if done.start is not None and done.kind != "paren":
            self.ended(done, done.end)
        self.stack.pop()
        place = self.stack[-1]
        if done.unit:
            self.out.closed(done.unit, end)
            place.clear()
        elif done.close == "}" and not self.scala:
            place.end = end
            if place.defined:
                self.ended(place, end)
            elif place.kind != "paren":
                place.clear()
        elif done.kind == "inner" and done.name:
            place.clear()
        else:
            place.end = end
            place.head.append({")": "()", "]": "[]"}.get(done.close, "{}"))

    def line_end(self, previous: str, following: tuple | None) -> None:
        """Scala: a line end also ends a statement that can end, before one that can begin."""
        text, start = following if following else ("", 0)
        column = self.out.column(start) if following else -1
        while self.stack[-1].close == "" and self.stack[-1].kind == "class" and column <= self.stack[-1].indent:
            done = self.stack[-1]
            self.ended(done, done.end)
            self.stack.pop()
            self.out.closed(done.unit, done.end or self.stack[-1].end)
            self.stack[-1].clear()
        place = self.stack[-1]
        if place.start is None or place.kind == "paren":
            return
        head = _bare(place.head)
        if not head or all(w in _SCALA_MODIFIERS or w == "[]" for w in head):
            return
        deeper = following is not None and column > place.indent_of_start
        found = _kind_and_name(head, _SCALA_KINDS, _SCALA_MODIFIERS)
        if place.kind == "root" and found and previous == ":" and deeper:
            body = _Open("", "class", found[1], self.out.opened(*found, place.start), place.indent_of_start)
            self.stack.append(body)
            return
        unit_head = found or place.defined
        if previous in _SCALA_AFTER or text in _SCALA_BEFORE or deeper or (text == "{" and unit_head):
            return
        self.ended(place, place.end)

    def run(self, tokens: list) -> None:
        source = self.out.source
        for k, (kind, text, start, end) in enumerate(tokens):
            place = self.stack[-1]
            if kind == "line":
                if self.scala and k:
                    following = next(((t, s) for x, t, s, _ in tokens[k + 1:k + 2]), None)
                    self.line_end(tokens[k - 1][1], following)
                continue
            if kind == "mark" and text in ")]}":
                # layout bodies end with the bracket around them; a stray bracket closes nothing
                if any(o.close == text for o in self.stack):
                    while self.stack[-1].close != text:
                        self.close(self.stack[-1].end or start)
                    self.close(end)
                continue
            if kind == "mark" and text == ";":
                place.end = end
                if place.kind in ("paren", "dead"):
                    place.clear()
                else:
                    self.ended(place, end if not self.scala else start)
                continue
            if place.start is None:
                place.start = start
                place.indent_of_start = self.out.column(start)
            if kind == "mark" and text in _CLOSES:
                inner = self.opens(text)
                self.stack.append(inner)
                continue
            place.end = end
            place.head.append(text if kind != "text" else '""')
            if self.scala and text == "def" and place.kind not in ("dead", "paren") and not place.defined \
                    and (place.kind == "root" or self.owner()) \
                    and all(w in _SCALA_MODIFIERS or w == "[]" for w in _bare(place.head)[:-1]):
                named = _SCALA_NAME.match(source, end)
                place.defined = named[1] if named else None
        while len(self.stack) > 1:
            self.close(self.stack[-1].end)
        if self.scala or self.stack[0].defined:
            self.ended(self.stack[0], self.stack[0].end)


def units_of(source: str | None, language: str) -> dict:
    """All units of a source in one of the known languages."""
    out = _Units(source or "")
    if language == "python":
        _python(out)
        return out.result()
    tokens, line = [], False
    for token in TOKENS[language].finditer(out.source):
        kind = token.lastgroup
        if kind == "note":
            # a comment over lines ends a line too
            line = line or "\n" in token.group()
        elif kind == "line":
            line = True
        else:
            if line and tokens:
                tokens.append(("line", "\n", token.start(), token.start()))
            line = False
            tokens.append((kind, token.group(), token.start(), token.end()))
    if tokens:
        tokens.append(("line", "\n", len(out.source), len(out.source)))
        _Braces(out, language == "scala").run(tokens)
    return out.result()
