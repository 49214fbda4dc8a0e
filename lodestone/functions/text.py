"""Text extraction as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from html import entities

from pyspark.sql import Column, functions as F

from . import rules

# Fixed value: the characters that count as white space when a text is stripped.
BLANKS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
          "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(text: Column) -> Column:
    """The text without leading and trailing white space, Unicode blanks included."""
    return F.btrim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it.

    Spark puts a column's expression wherever the column is used when it moves a
    filter below a projection; bound like this, a costly one is not multiplied.
    """
    return F.transform(F.array(value), body)[0]


def interleave(between: Column, marked: Column) -> Column:
    """Join the n+1 texts around n marked texts back into one text."""
    return F.array_join(
        F.zip_with(between, marked, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def half_up(value: Column, digits: int) -> Column:
    """Rounded to so many digits, halves up, in plain double arithmetic."""
    scale = 10 ** digits
    return F.floor(value * scale + 0.5) / scale


# ---- HTML ---------------------------------------------------------------

# script, style and template texts, comments, declarations, then any tag;
# the quantifiers are possessive so that long attributes need no stack
_MARKUP = (
    r"(?is)<!--.*?-->|<(script|style|template)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*+>|\z)"
    r"|<[a-z/!?](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
)


def _literal_map(pairs) -> Column:
    """A constant string map, as one literal rather than one per entry."""
    return F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in pairs)),
                        F.lit("\x02"), F.lit("\x01"))


def _entity_maps() -> tuple[Column, Column]:
    """Named characters from the standard library, the common short set first."""
    short = [(name, chr(point)) for name, point in sorted(entities.name2codepoint.items())]
    known = {name for name, _ in short}
    rest = [(name[:-1], value) for name, value in sorted(entities.html5.items())
            if name.endswith(";") and name[:-1] not in known]
    return _literal_map(short), _literal_map(rest)


def _code_point(n: Column) -> Column:
    # numbers 128 to 159 are read as the Windows code page, as browsers do
    page = {i: bytes([i]).decode("cp1252", "ignore") for i in range(128, 160)}
    windows = F.create_map(*[F.lit(x) for i, c in page.items() if c for x in (i, c)])
    valid = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    return (F.when(n.between(128, 159), F.coalesce(F.try_element_at(windows, n.cast("int")), F.lit("\ufffd")))
            .when(valid, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
            .otherwise(F.lit("\ufffd")))


def unescape(text: Column) -> Column:
    """Character references resolved; an unknown name stays, without its semicolon."""
    ref = r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][-.a-zA-Z0-9]*);?"
    short, rest = _entity_maps()

    def one(name: Column) -> Column:
        digits = F.regexp_replace(name, "^#[xX]?0*(?=.)", "")
        # more than eight digits without leading zeros is no character
        number = F.when(F.lower(name).startswith("#x"), F.when(F.length(digits) <= 8, F.conv(digits, 16, 10))) \
            .otherwise(digits).try_cast("bigint")
        named = F.coalesce(F.try_element_at(short, name), F.try_element_at(rest, name),
                           F.concat(F.lit("&"), name))
        return F.when(name.startswith("#"), _code_point(number)).otherwise(named)

    resolved = interleave(F.split(text, ref, -1),
                          F.transform(F.regexp_extract_all(text, F.lit(ref), 1), one))
    return F.when(text.contains("&"), resolved).otherwise(text)


def _text_nodes(html: Column) -> Column:
    """What stands between the tags, resolved and stripped: one more than there are tags."""
    return F.transform(F.split(html, _MARKUP, -1), lambda p: strip(unescape(p)))


def html_to_text(html: Column) -> Column:
    """Visible text nodes, stripped, blank ones dropped, one per line."""
    return F.array_join(F.filter(_text_nodes(html), lambda p: p != ""), "\n")


# Elements without content.
_VOID = ("area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image", "img", "input",
         "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param", "source", "spacer", "track", "wbr")
_ELEMENT = "struct<no:int,count:int,row:boolean,start:int,end:int>"
_OPEN = "array<struct<name:string,no:int,start:int>>"


def _elements(tags: Column) -> Column:
    """Rows and cells among the tags in order of their start, as far as each reaches.

    A fold with the stack of open elements. An end tag closes the last open element of
    its name and all inside it; without one it closes nothing. ``no`` numbers rows and cells,
    ``count`` is how many of them an element holds, ``start`` and ``end`` are numbers of tags.
    """
    first = F.struct(F.array().cast(_OPEN).alias("open"), F.array().cast(f"array<{_ELEMENT}>").alias("done"), F.lit(0).alias("n"))
    facts = F.transform(tags, lambda t, i: F.struct(
        i.alias("i"), F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][^\s/>]*)", 1)).alias("name"),
        t.startswith("</").alias("ends"), F.rlike(t, F.lit(r"(?is)/>\z|</(?:script|style|template)\s*>\z")).alias("whole")))

    def kept(name: Column) -> Column:
        return name.isin("tr", "td", "th")

    def closed(acc: Column, depth: Column, at: Column) -> Column:
        """Everything above a depth leaves the stack."""
        gone = F.filter(F.slice(acc["open"], depth + 1, F.size(acc["open"])), lambda e: kept(e["name"]))
        ended = F.transform(gone, lambda e: F.struct(
            e["no"].alias("no"), (acc["n"] - e["no"] - 1).alias("count"), (e["name"] == "tr").alias("row"),
            e["start"].alias("start"), at.cast("int").alias("end")))
        return F.struct(F.slice(acc["open"], F.lit(1), depth).alias("open"), F.concat(acc["done"], ended).alias("done"),
                        acc["n"].alias("n"))

    def step(acc: Column, tag: Column) -> Column:
        named = F.transform(acc["open"], lambda e: e["name"])
        # the last of the name, counted from 1
        last = F.size(named) + 1 - F.array_position(F.reverse(named), tag["name"]).cast("int")
        opened = F.struct(
            F.concat(acc["open"], F.array(F.struct(tag["name"].alias("name"), acc["n"].alias("no"), tag["i"].alias("start")))).alias("open"),
            acc["done"].alias("done"), (acc["n"] + kept(tag["name"]).cast("int")).alias("n"))
        return (F.when((tag["name"] == "") | (~tag["ends"] & (tag["whole"] | tag["name"].isin(*_VOID))), acc)
                .when(~tag["ends"], opened)
                .when(F.array_contains(named, tag["name"]), closed(acc, last - 1, tag["i"]))
                .otherwise(acc))

    whole = F.aggregate(facts, first, step)
    return F.array_sort(closed(whole, F.lit(0), F.size(tags))["done"])


def table_to_text(html: Column) -> Column:
    """Rows of an HTML table as lines, cells joined by a bar.

    A row has all cells below it, those of a nested table too, and a cell all texts below
    it. What is not closed reaches to the end of what holds it.
    """
    def rows(nodes: Column, elements: Column) -> Column:
        def line(row: Column) -> Column:
            cells = F.filter(F.slice(elements, row["no"] + 2, row["count"]), lambda e: ~e["row"])
            return F.struct(F.size(cells).alias("n"), F.array_join(F.transform(cells, lambda c: F.array_join(
                F.slice(nodes, c["start"] + 2, c["end"] - c["start"]), "")), " | ").alias("text"))

        found = F.filter(F.transform(F.filter(elements, lambda e: e["row"]), line), lambda r: r["n"] > 0)
        return F.array_join(F.transform(found, lambda r: r["text"]), "\n")

    return let(_text_nodes(html), lambda nodes: let(
        _elements(F.regexp_extract_all(html, F.lit(f"({_MARKUP})"), 1)), lambda elements: rows(nodes, elements)))


def html_tables(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?is)(<table.*?>.*?</table>)"), 1)


# ---- mentions -----------------------------------------------------------

def config_keys(text: Column) -> Column:
    """Distinct configuration keys, sorted."""
    found = F.sort_array(F.array_distinct(
        F.regexp_extract_all(text, F.lit(f"({rules.CONFIG_KEY})"), 1)))
    # most texts name none: a plain search is cheaper than the pattern
    return F.when(text.contains("spark."), found).otherwise(F.array().cast("array<string>"))


def version_mentions(text: Column) -> Column:
    """Distinct versions with a major of 1 to 9, in order of first mention."""
    found = F.regexp_extract_all(text, F.lit(rules.VERSION_MENTION), 1)
    # a plausible major is one digit after leading zeros
    return F.array_distinct(F.filter(found, lambda v: F.rlike(v, F.lit(r"^0*[1-9]\."))))


def label_versions(labels: Column, milestone: Column) -> Column:
    """The first version number of each label and of the milestone, distinct, sorted."""
    names = F.concat(F.coalesce(labels, F.array().cast("array<string>")), F.array(milestone))
    found = F.transform(names, lambda s: F.regexp_extract(s, rules.VERSION_NUMBER, 1))
    return F.sort_array(F.array_distinct(F.filter(found, lambda v: v.isNotNull() & (v != ""))))


def all_versions(labels: Column, milestone: Column, text: Column) -> Column:
    return F.sort_array(F.array_union(label_versions(labels, milestone), version_mentions(text)))


def pr_refs(text: Column) -> Column:
    """Referenced change numbers, distinct, ascending."""
    found = F.regexp_extract_all(text, F.lit(f"({rules.PR_REFERENCE})"), 1)
    numbers = F.transform(found, lambda r: F.regexp_extract(r, "([0-9]+)$", 1).try_cast("bigint"))
    return F.sort_array(F.array_distinct(F.filter(numbers, lambda n: n.isNotNull())))


# ---- classification -----------------------------------------------------

def matches(text: Column, rule: rules.Rule, pattern: str) -> Column:
    """Whether the pattern occurs; the rule's fixed word, if any, is looked for first."""
    found = F.rlike(text, F.lit(pattern))
    return text.contains(rule.word) & found if rule.word else found


def error_types(text: Column, error_rules=rules.ERROR_RULES) -> Column:
    """Names of all error classes found, in rule order."""
    hits = F.array(*[F.when(matches(text, r, r.pattern), F.lit(r.name)) for r in error_rules])
    return F.filter(hits, lambda n: n.isNotNull())


def first_error(text: Column, error_rules=rules.ERROR_RULES) -> Column:
    return F.coalesce(F.try_element_at(error_types(text, error_rules), F.lit(1)), F.lit(""))


def is_stacktrace(text: Column) -> Column:
    test = F.lit(False)
    for pattern in rules.STACKTRACE_PATTERNS:
        test = test | F.rlike(text, F.lit(f"(?dm){pattern}"))
    return test


def _starts(line: Column, prefixes) -> Column:
    test = F.lit(False)
    for p in prefixes:
        test = test | line.startswith(p)
    return test


def classify_input(text: Column) -> Column:
    """``logs``, ``code`` or ``question``."""
    def points(raw: Column) -> Column:
        line = strip(raw)
        ends = line.contains("=")
        for suffix in rules.CODE_LINE_ENDS:
            ends = ends | line.endswith(suffix)
        return (_starts(line, rules.CODE_LINE_STARTS).cast("int") + ends.cast("int")
                + _starts(line, rules.CODE_COMMENT_STARTS).cast("int"))

    lines = F.split(strip(text), "\n")
    total = F.aggregate(lines, F.lit(0), lambda acc, line: acc + points(line))
    return (F.when(is_stacktrace(text), "logs")
            .when(total / F.size(lines) > rules.CODE_LINE_SHARE, "code")
            .otherwise("question"))


def detect_language(path: Column) -> Column:
    """Language by file ending, null for any other file."""
    found = F.lit(None).cast("string")
    for language, ending in rules.LANGUAGE_ENDINGS.items():
        found = F.when(path.endswith(ending), language).otherwise(found)
    return found


def as_list(values: Column) -> Column:
    """The list, or an empty one for null."""
    return F.coalesce(values, F.array().cast("array<string>"))


def unwrap_list(json: Column, key: str) -> Column:
    """The list inside ``{"key": [...]}``; null and blank give an empty list."""
    return as_list(F.from_json(json, f"`{key}` array<string>")[key])


def wrap_list(values: Column, key: str) -> Column:
    """``{"key": [...]}`` as text; a null list counts as empty."""
    return F.to_json(F.struct(F.coalesce(values, F.array()).alias(key)))


def source_label(source: Column) -> Column:
    """Served table name without its prefix, as words in title case."""
    served = F.coalesce(
        F.create_map(*[F.lit(x) for pair in rules.SERVED_NAMES.items() for x in pair])[source],
        source)
    return F.initcap(F.replace(F.replace(served, F.lit("spark_"), F.lit("")), F.lit("_"), F.lit(" ")))
