"""The registered queries as SQL for DuckDB, written independently of the Spark plans:
line tables, joins to rule tables and plain cross products where the Spark side uses
folds, literal rules and block scoring."""

from __future__ import annotations

from ..functions import rules
from ..views import VIEWS, cte, filled
from .registry import OWN_APIS, OWN_PROBLEMS, SINCE

ORACLES: dict[str, str] = {}


def lit(text: str) -> str:
    """A string literal; line feeds are spelled as chr(10)."""
    return "concat('" + text.replace("'", "''").replace("\n", "', chr(10), '") + "')" \
        if "\n" in text else "'" + text.replace("'", "''") + "'"


def with_(*parts: str, select: str) -> str:
    return "with " + ",\n".join(parts) + "\n" + select


def bar(items: str) -> str:
    return f"coalesce(array_to_string({items}, '|'), '')"


NS = "from_hex('a1b2c3d4e5f67890abcdef1234567890')"
STRIP = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '\\A{STRIP}+', ''), '{STRIP}+\\z', '')"


def hash16(x: str) -> str:
    return f"substr(sha256({x}), 1, 16)"


def uuid5(key: str) -> str:
    h = f"sha1({NS} || encode({key}))"
    return (f"concat(substr({h},1,8), '-', substr({h},9,4), '-5', substr({h},14,3), '-', "
            f"translate(substr({h},17,1), '0123456789abcdef', '89ab89ab89ab89ab'), substr({h},18,3), '-', substr({h},21,12))")


# ---- parts ----

def fold(parts: str, gap: int, limit: int = 2048) -> str:
    """Greedy packing of a list of parts: a fold over {done, open, n}."""
    sep = "chr(10)" if gap == 1 else "concat(chr(10), chr(10))"
    items = (f"list_transform({parts}, "
             "lambda p: {'done': []::varchar[], 'open': p, 'n': length(p)::bigint})")
    start = "{'done': []::varchar[], 'open': null::varchar, 'n': 0::bigint}"
    closed = "case when a.open is null then a.done else list_append(a.done, a.open) end"
    step = (f"case when a.open is not null and a.n + b.n > {limit} "
            f"then {{'done': {closed}, 'open': b.open, 'n': b.n + {gap}}} "
            f"else {{'done': a.done, 'open': case when a.open is null then b.open "
            f"else concat(a.open, {sep}, b.open) end, 'n': a.n + b.n + {gap}}} end")
    return f"list_transform([list_reduce({items}, lambda a, b: {step}, {start})], lambda a: {closed})[1]"


def packed(name: str, source: str, keys: str, text: str) -> str:
    """``name(keys, piece_no, piece)``: paragraphs over the limit split the rest into runs."""
    paras = f"string_split({text}, concat(chr(10), chr(10)))"
    return f"""{name}_p as (select {keys}, unnest({paras}) as p, generate_subscripts({paras}, 1) as i from {source} where length({text}) > 2048),
{name}_r as (select *, length(p) > 2048 as big, sum(case when length(p) > 2048 then 1 else 0 end) over (partition by {keys} order by i) as r from {name}_p),
{name}_g as (select {keys}, r, big, list(p order by i) as ps from {name}_r group by {keys}, r, big),
{name}_q as (select {keys}, r, big, case when big then {fold("string_split(ps[1], chr(10))", 1)} else {fold("ps", 2)} end as pieces from {name}_g),
{name}_u as (select {keys}, r, big, unnest(pieces) as piece, generate_subscripts(pieces, 1) as j from {name}_q),
{name} as (select {keys}, row_number() over (partition by {keys} order by r, big desc, j) - 1 as piece_no, piece from {name}_u
  union all select {keys}, 0, {text} from {source} where length({text}) <= 2048)"""


def lines(name: str, source: str, keys: str, text: str) -> str:
    parts = f"string_split({text}, chr(10))"
    return (f"{name} as (select {keys}, unnest({parts}) as line, "
            f"generate_subscripts({parts}, 1) as i from {source})")


def rule_rows(name: str, rule_list) -> str:
    rows = ", ".join(
        f"({i}, {lit(r.name)}, {lit(r.risk)}, {lit(r.description)}, {lit(r.pattern)}, {lit(r.unless)}, {str(r.spans_lines).lower()})"
        for i, r in enumerate(rule_list))
    return f"{name}(rule_no, name, risk, description, pattern, unless, spans) as (values {rows})"


def apis(name: str, source: str, key: str, text: str, rule_list=rules.API_RULES) -> str:
    """``name(key, apis, first_lines)`` for keys with any API."""
    return f"""{rule_rows(name + "_rules", rule_list)},
{lines(name + "_l", source, key, text)},
{name}_h as (select {key}, rule_no, name, min(i) as line from {name}_l join {name}_rules on regexp_matches(line, pattern) group by all),
{name} as (select {key}, list(name order by line, rule_no) as apis, list(line order by line, rule_no) as first_lines from {name}_h group by {key})"""


def problems(name: str, source: str, key: str, text: str, rule_list=rules.PROBLEM_RULES) -> str:
    """``name(key, rule_no, name, risk, description, line, match_text)``."""
    return f"""{rule_rows(name + "_rules", rule_list)},
{lines(name + "_l", source, key, text)},
{name}_one as (select {key}, rule_no, min(i) as line, arg_min(line, i) as found from {name}_l join {name}_rules on not spans and regexp_matches(line, pattern) group by all),
{name}_many as (select {key}, rule_no, regexp_extract({text}, pattern) as found, {text} as txt from {source} join {name}_rules on spans and regexp_matches({text}, pattern)),
{name}_all as (select {key}, rule_no, line, found from {name}_one union all
  select {key}, rule_no, 1 + length(left(txt, strpos(txt, found) - 1)) - length(replace(left(txt, strpos(txt, found) - 1), chr(10), '')), found from {name}_many),
{name} as (select h.{key}, h.rule_no, r.name, r.risk, r.description, h.line, {strip("h.found")} as match_text
  from {name}_all h join {name}_rules r using (rule_no) join {source} s on s.{key} = h.{key}
  where r.unless = '' or not regexp_matches(s.{text}, r.unless))"""


def errors(text: str) -> str:
    cases = ", ".join(f"case when regexp_matches({text}, {lit(r.pattern)}) then {lit(r.name)} end"
                      for r in rules.ERROR_RULES)
    return f"list_filter([{cases}], lambda e: e is not null)"


def stacktrace(text: str) -> str:
    return "(" + " or ".join(f"regexp_matches({text}, {lit('(?m)' + p)})" for p in rules.STACKTRACE_PATTERNS) + ")"


def input_types(name: str, source: str, key: str, text: str) -> str:
    """``name(key, input_type)``."""
    return f"""{lines(name + "_l", source, key, strip(text))},
{name}_s as (select {key}, {strip("line")} as l from {name}_l),
{name}_p as (select {key}, count(*) as n, sum(regexp_matches(l, '^(def |val |var |class |import |from |public |private )')::int
   + (regexp_matches(l, '[{{}}:);]$') or contains(l, '='))::int + regexp_matches(l, '^(//|#|/[*]|[*])')::int) as points from {name}_s group by {key}),
{name} as (select s.{key}, case when {stacktrace("s." + text)} then 'logs' when points / n > 0.3 then 'code' else 'question' end as input_type
  from {source} s join {name}_p using ({key}))"""


def versions(text: str) -> str:
    found = f"list_filter(regexp_extract_all({text}, {lit(rules.VERSION_MENTION)}, 1), lambda v: split_part(v, '.', 1)::bigint between 1 and 9)"
    return f"list_filter({found}, lambda v, k: list_position({found}, v) = k)"


def labelled(label: str, milestone: str) -> str:
    found = f"list_filter([regexp_extract({label}, {lit(rules.VERSION_NUMBER)}, 1), regexp_extract(coalesce({milestone}, ''), {lit(rules.VERSION_NUMBER)}, 1)], lambda v: v <> '')"
    return f"list_sort(list_distinct({found}))"


def prs(text: str) -> str:
    found = f"regexp_extract_all({text}, {lit(rules.PR_REFERENCE)})"
    return f"list_sort(list_distinct(list_transform({found}, lambda r: regexp_extract(r, '([0-9]+)$', 1)::bigint)))"


def configs(text: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all({text}, {lit(rules.CONFIG_KEY)})))"


def entities(x: str) -> str:
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        x = f"regexp_replace({x}, '&{name};?', '{char}', 'g')"
    return x


def html(x: str) -> str:
    for pattern in (r"(?is)<!--.*?-->", r"(?is)<script\b[^>]*>.*?(?:</script\s*>|\z)",
                    r"(?is)<style\b[^>]*>.*?(?:</style\s*>|\z)",
                    r"""(?i)<[a-z/!?](?:[^>"']|"[^"]*"|'[^']*')*>"""):
        x = f"regexp_replace({x}, {lit(pattern)}, chr(1), 'g')"
    nodes = f"list_transform(string_split({x}, chr(1)), lambda t: {strip(entities('t'))})"
    return f"array_to_string(list_filter({nodes}, lambda t: t <> ''), chr(10))"


def table_text(x: str) -> str:
    cell = strip("regexp_replace(c, '<[^>]*>', '', 'g')")
    cells = rf"list_transform(regexp_extract_all(r, '(?is)<t[hd]\b[^>]*>(.*?)</t[hd]\s*>', 1), lambda c: {cell})"
    return (rf"array_to_string(list_transform(regexp_extract_all({x}, '(?is)<tr\b[^>]*>(.*?)</tr\s*>', 1), "
            f"lambda r: array_to_string({cells}, ' | ')), chr(10))")


def signature(x: str) -> str:
    def before(mark):
        return strip(f"split_part({x}, '{mark}', 1)")
    cases = " ".join(f"when contains({x}, '{m}') and {before(m)} <> '' then {before(m)}" for m in ("{", ":", "=>"))
    first = strip(f"split_part({x}, chr(10), 1)")
    return f"case {cases} else {first} end"


def embedded(name: str, source: str, key: str, text: str, dim: int = 64) -> str:
    """``name(key, vec)``."""
    return f"""{name}_k as (select distinct {key}, {text} as txt from {source}),
{name}_t as (select {key}, md5(unnest(regexp_extract_all(lower(txt), '[\\p{{L}}\\p{{N}}_]+'))) as h from {name}_k),
{name}_c as (select {key}, concat('0x', substr(h, 1, 8))::bigint % {dim} as b, sum(case when substr(h, 9, 1) < '8' then 1 else -1 end)::bigint as v from {name}_t group by all),
{name}_n as (select {key}, sqrt(sum(v * v)::double) as norm from {name}_c group by {key}),
{name} as (select k.{key}, list((case when coalesce(norm, 0) > 0 then coalesce(c.v, 0) / norm else 0 end)::float order by d.b) as vec
  from {name}_k k cross join (select unnest(range({dim})) as b) d left join {name}_n n using ({key})
  left join {name}_c c on c.{key} = k.{key} and c.b = d.b group by k.{key})"""


def print_of(vec: str) -> str:
    return f"array_to_string(list_transform({vec}, lambda x: cast(round(x::double * 1000000) as bigint)::varchar), ',')"


def cosine(a: str, b: str) -> str:
    return f"round(list_cosine_similarity({a}::double[], {b}::double[]), 6)"


def half_up(x: str, digits: int) -> str:
    return f"floor({x} * {10 ** digits} + 0.5) / {10 ** digits}"


def nearest(name: str, queries: str, key: str, corpus: str, k: int, where: str = "true") -> str:
    """``name(key, source, vec_id, sim, rank)`` of queries(key, vec) over a view's embeddings."""
    return f"""{name}_s as (select q.{key}, c.source, c.vec_id, {cosine("q.vec", "c.embedding")} as sim
  from {queries} q cross join {corpus} c where {where}),
{name} as (select *, row_number() over (partition by {key}, source order by sim desc, vec_id) as rank from {name}_s
  qualify rank <= {k})"""


def weight(kind: str, source: str, weights=rules.SOURCE_WEIGHTS) -> str:
    cases = " ".join(f"when {kind} = '{t}' and {source} = '{s}' then {w}::double"
                     for t, ws in weights.items() for s, w in ws.items())
    return f"case {cases} else 0.1::double end"


def score(request_apis: str, version: str, weights=rules.SOURCE_WEIGHTS) -> str:
    """Of a row with sim, input_type and the facts f of the hit."""
    return f"""(sim * ({weight("input_type", "h.source", weights)})
  + (case when h.source in ('code', 'qa') then 0.05::double * len(list_intersect({request_apis}, f.apis)) else 0::double end)
  + (case when h.source = 'qa' and f.score > 10 then 0.03::double else 0::double end)
  + (case when h.source = 'qa' and f.is_accepted then 0.05::double else 0::double end)
  + (case when h.source = 'issues' and f.state = 'closed' then 0.02::double else 0::double end)
  + (case when h.source in ('qa', 'issues') and len(list_filter(f.versions, lambda v: contains(v, {version}))) > 0 then 0.04::double else 0::double end))"""


POSITION = ("row_number() over (partition by {key} order by score desc, "
            "case source when 'code' then 0 when 'docs' then 1 when 'qa' then 2 else 3 end, rank)")
V41 = "(c.source not in ('code', 'docs') or c.spark_version = '4.1.0')"

# ---- the served chunk tables, with the JSON of their own columns ----

PLACES = {"spark_version": "varchar", "file_path": "varchar", "doc_url": "varchar", "question_id": "bigint", "issue_number": "bigint"}
_SERVED = {
    "code": ("spark_version, file_path, language, chunk_type, qualified_name, signature, spark_apis, problem_indicators",
             {"problem_indicators": "string_split(problems, ',')"}),
    "docs": ("spark_version, doc_url, doc_section, heading_hierarchy, content_type, related_configs", {}),
    "qa": ("question_id, is_question, score, is_accepted, tags, error_type, spark_apis_mentioned, spark_versions_mentioned", {}),
    "issues": ("issue_number, state, is_comment, parent_issue_number, author, labels, created_at, closed_at, spark_versions_mentioned, linked_prs",
               {"linked_prs": "[pr::bigint]"})}


def _served(source: str) -> str:
    columns, own = _SERVED[source]
    names = columns.split(", ")
    shown = ", ".join(f"'{c}': {own.get(c, c)}" for c in names)
    places = ", ".join(c if c in names else f"null::{kind} as {c}" for c, kind in PLACES.items())
    return f"select '{source}' as source, chunk_id as vec_id, content, to_json({{{shown}}})::varchar as metadata, {places} from {source}_served"


SERVED = ",\n".join(cte(f"{s}_served") for s in _SERVED) + ",\nserved as (" + "\n union all ".join(map(_served, _SERVED)) + ")"
BESIDE = ", ".join(f"s.{c}" for c in PLACES)

# ---- the Markdown documents, by lines ----

_EX = "concat('ex', cast(doc_id % 4 as varchar))"
INCLUDED = f"""lookup as (select concat('ex', cast(p_partkey * 2 as varchar)) as key, content as code from code_files),
md_included as (select doc_id, file_path, spark_version, replace(d.content, concat('{{% include_example ', {_EX}, ' python/ex.py %}}'),
  coalesce('```' || chr(10) || l.code || chr(10) || '```', concat('[Example: ', {_EX}, ' (python/ex.py)]'))) as content
  from md_docs d left join lookup l on l.key = {_EX})"""
MD = f"""{cte("md_docs")},
{cte("code_files")},
{INCLUDED},
{lines("md_l", "md_included", "doc_id", "content")},
md_f as (select *, starts_with(line, '```') as is_fence, sum(case when starts_with(line, '```') then 1 else 0 end) over (partition by doc_id order by i) as nf from md_l),
md_k as (select *, case when is_fence or nf % 2 = 1 then 'code_example' when starts_with(line, '<table') then 'config_table'
   when regexp_matches(line, '^#{{1,6}}\\s+.+$') then 'heading' else 'prose' end as kind from md_f),
md_s as (select *, sum(case when kind = 'heading' then 1 else 0 end) over (partition by doc_id order by i) as section_no from md_k),
md_h as (select doc_id, section_no, i, length(regexp_extract(line, '^(#+)', 1)) as level, {strip("regexp_extract(line, '^#{1,6}\\s+(.+)$', 1)")} as heading from md_s where kind = 'heading'),
md_stack as (select doc_id, list_reduce(list({{'level': level, 'h': heading, 'paths': []::varchar[][], 'stack': []::varchar[]}} order by i),
   lambda a, b: {{'level': b.level, 'h': b.h, 'paths': list_append(a.paths, list_append(a.stack[1:least(len(a.stack), b.level - 1)], b.h)), 'stack': list_append(a.stack[1:least(len(a.stack), b.level - 1)], b.h)}},
   {{'level': 0::bigint, 'h': '', 'paths': []::varchar[][], 'stack': []::varchar[]}}).paths as paths from md_h group by doc_id),
md_paths as (select doc_id, unnest(paths) as path, generate_subscripts(paths, 1) as section_no from md_stack)"""

MD_CHUNKS = f"""{MD},
md_b as (select *, case when kind = 'code_example' and is_fence and nf % 2 = 1 then 1 when kind = 'config_table' then 1
   when kind = 'prose' and lag(kind) over (partition by doc_id, section_no order by i) is distinct from 'prose' then 1 else 0 end as starts from md_s where kind <> 'heading'),
md_n as (select *, sum(starts) over (partition by doc_id, section_no order by i) as part from md_b),
md_raw as (select doc_id, section_no, part, any_value(kind) as content_type, string_agg(line, chr(10) order by i) filter (not is_fence) as raw from md_n group by doc_id, section_no, part),
md_t as (select doc_id, section_no, part, content_type, case when content_type = 'config_table' then {table_text("raw")} else {strip("raw")} end as txt from md_raw),
md_p as (select *, row_number() over (partition by doc_id, section_no order by part) - 1 as part_no from md_t
   where case when content_type = 'prose' then length(txt) > 20 else {strip("txt")} <> '' end),
{packed("md_pieces", "md_p", "doc_id, section_no, part_no", "txt")},
md_chunks as (select c.doc_id, c.section_no, c.part_no, c.piece_no, d.file_path as doc_url, coalesce(h.path[1], '') as doc_section,
   coalesce(h.path, []) as path, p.content_type, {configs("p.txt")} as configs, c.piece as content, d.spark_version
   from md_pieces c join md_p p using (doc_id, section_no, part_no) join md_docs d using (doc_id) left join md_paths h using (doc_id, section_no))"""

# ---- threads and issues ----

QA = f"""{cte("qa_threads")},
qa_c as (select *, case when is_question then concat(title, chr(10), chr(10), {html("body")}) else {html("body")} end as content,
   question_id * 1000 + turn as id from qa_threads),
{apis("qa_a", "qa_c", "id", "content")},
qa as (select c.*, coalesce(a.apis, []) as apis, {versions("content")} as versions, {errors("content")} as errs,
   {uuid5("concat('so:', question_id, ':', case when is_question then 'q' else 'a' end, ':', " + hash16("content") + ")")} as chunk_id
   from qa_c c left join qa_a a using (id))"""

ISSUES = f"""{cte("issue_threads")},
issues as (select *, case when is_comment then body else concat(title, chr(10), chr(10), body) end as content from issue_threads)"""

# ---- code ----

CODE = f"""{cte("code_files")},
{lines("cl", "code_files", "p_partkey", "content")},
cf as (select *, length(line) - length(ltrim(line)) as indent, trim(line) <> '' as full_line from cl),
heads as (select p_partkey, i, indent, case when regexp_matches(line, '^(import|from) ') then 'import' when starts_with(line, 'class ') then 'class' else 'method' end as kind,
   regexp_extract(line, '^\\s*(?:def|class)\\s+(\\w+)', 1) as name from cf where regexp_matches(line, '^(import|from|class) ') or regexp_matches(line, '^\\s*def ')),
spans as (select h.*, coalesce(a.after, 1000000) as after from heads h
   left join (select h.p_partkey, h.i, min(l.i) as after from heads h join cf l on l.p_partkey = h.p_partkey and l.i > h.i and l.full_line and l.indent <= h.indent group by all) a using (p_partkey, i)),
ends as (select s.*, max(l.i) as last from spans s join cf l on l.p_partkey = s.p_partkey and l.full_line and l.i >= s.i and l.i < s.after group by all),
bodies as (select e.p_partkey, e.i, e.indent, e.kind, e.name, e.last, ltrim(string_agg(l.line, chr(10) order by l.i)) as content
   from ends e join cf l on l.p_partkey = e.p_partkey and l.i between e.i and e.last group by all),
units as (select b.*, (select arg_max(c.name, c.i) from heads c where c.p_partkey = b.p_partkey and c.kind = 'class' and c.i < b.i and b.indent > 0) as class_name,
   {signature("b.content")} as signature, b.p_partkey * 1000 + b.i as id from bodies b),
methods as (select *, concat_ws('.', class_name, name) as qualified_name from units where kind = 'method'),
summaries as (select c.p_partkey, c.name as qualified_name, concat('class ', c.name) as signature,
   concat('class ', c.name, chr(10), chr(10), 'Methods:', chr(10), string_agg(concat('  ', m.signature), chr(10) order by m.i)) as content, c.i as start_line, c.last as end_line
   from units c join methods m on m.p_partkey = c.p_partkey and m.class_name = c.name where c.kind = 'class' group by c.p_partkey, c.name, c.i, c.last)"""

# the units that stand in the templates: kind, class, name, first and last line, text
_UNITS = {
    0: [("imports", None, None, 1, 0, "import os\nfrom a import (\n    b,\n)"),
        ("class_summary", "K{n}", "class", 10, 16, "class K{n}\n\nMethods:\n  def run(self, df)"),
        ("method", "K{n}", "run", 14, 16, 'def run(self, df):\n        s = "} # not a comment"\n        return df.collect()'),
        ("method", None, "top{size}", 18, 19, "def top{size}(a):\n    return a")],
    1: [("imports", None, None, 1, 0, "package org.x\nimport a.{B, C}"),
        ("class_summary", "K{n}", "class", 4, 5, "class K{n}\n\nMethods:\n  def one = 1\n  def two(x: Int): Int ="),
        ("method", "K{n}", "one", 5, 5, "def one = 1"), ("method", "K{n}", "two", 5, 5, "def two(x: Int): Int = { x + a }"),
        ("class_summary", "K{n}", "object", 7, 14, "object K{n}\n\nMethods:\n  def apply(\n      a\n  def run(df"),
        ("method", "K{n}", "apply", 10, 12, "def apply(\n      a: Int): K{n} =\n    new K{n}(a)"),
        ("method", "K{n}", "run", 13, 13, "def run(df: D) = df.collect()")],
    2: [("imports", None, None, 1, 0, "package a.b;\nimport x.Y;"),
        ("class_summary", "K{n}", "class", 4, 9, "class K{n}\n\nMethods:\n  public void go()\n  @Override public <U> List<U> get(String a,\n      int b) throws E\n  void two()\n  abstract int last(int a);"),
        ("method", "K{n}", "go", 5, 5, "public void go() { x(); }"),
        ("method", "K{n}", "get", 6, 7, '@Override public <U> List<U> get(String a,\n      int b) throws E { String s = "} void no() {"; return null; }'),
        ("method", "K{n}", "two", 7, 7, "void two() { d.collect(); }"), ("method", "K{n}", "last", 8, 8, "abstract int last(int a);"),
        ("class_summary", "I{size}", "interface", 10, 10, "interface I{size}\n\nMethods:\n  int one(int a);\n  default int two()"),
        ("method", "I{size}", "one", 10, 10, "int one(int a);"), ("method", "I{size}", "two", 10, 10, "default int two() { return 2; }")],
}


def _unit(third: int, no: int, unit: tuple) -> str:
    kind, owner, name, first, last, text = unit
    label = "concat(file_path, ':imports')" if kind == "imports" else filled(
        owner if kind == "class_summary" else f"{owner}.{name}" if owner else name)
    shown = filled(f"{name} {owner}") if kind == "class_summary" else "''" if kind == "imports" else signature(filled(text))
    return (f"select p_partkey, p_partkey * 100 + {no} as id, '{kind}' as chunk_type, {label} as qualified_name, {shown} as signature, "
            f"{first} as start_line, {last} as end_line, {filled(text)} as content from unit_files where p_partkey % 3 = {third}").replace("NL", "chr(10)")


# ---- requests ----

ASKED = f"""{cte("log_texts")},
asked as (select distinct input, md5(input) as id from log_texts),
{input_types("kinds", "asked", "id", "input")},
{apis("asked_apis", "asked", "id", "input")},
{problems("asked_problems", "asked", "id", "input")},
parsed as (select a.id, a.input, k.input_type, coalesce(x.apis, []) as apis, {errors("a.input")} as errs,
   coalesce((select list(p.name order by p.rule_no) from asked_problems p where p.id = a.id), []) as patterns
   from asked a join kinds k using (id) left join asked_apis x using (id))"""

# ---- benchmark texts as queries ----

HELD = f"""held as (select item_id, text as input, ['code', 'logs', 'question'][(item_id % 3 + 1)::int] as input_type from benchmark),
{embedded("held_v", "held", "item_id", "input")},
{cte("vec_facts")}"""
SCORED = f"""{HELD},
{nearest("hits", "held_v", "item_id", "vec_facts", 10, V41)},
scored as (select h.*, {score("['DataFrame.collect', 'RDD.map']", "'4.1.0'")} as score, f.spark_version
   from hits h join vec_facts f using (vec_id) join held using (item_id)),
merged as (select *, {POSITION.format(key="item_id")} as position from scored qualify position <= 20)"""


def sql(name: str, text: str) -> None:
    ORACLES[name] = text


sql("pack_lines", with_(
    f"p as (select doc_id, {fold('string_split(text, chr(10))', 1)} as pieces from documents)",
    "u as (select doc_id, unnest(pieces) as piece, generate_subscripts(pieces, 1) - 1 as piece_no from p)",
    select="select doc_id, piece_no, length(piece) as n_chars, md5(piece) as piece_md5 from u"))
sql("pack_paragraphs", with_(cte("md_docs"), packed("pieces", "md_docs", "doc_id", "content"),
    select="select doc_id, piece_no, length(piece) as n_chars, md5(piece) as piece_md5 from pieces"))
sql("chunk_id", f"""select doc_id, {hash16("text")} as content_hash,
  {uuid5("concat('4.1.0:', source, ':', lang, ':', n_chars)")} as code_id,
  {uuid5("concat('4.1.0:', source, ':', lang, ':', " + hash16("text") + ")")} as doc_chunk_id,
  {uuid5("concat('so:', doc_id, ':', case when lang = 'en' then 'q' else 'a' end, ':', " + hash16("text") + ")")} as qa_id,
  {uuid5("concat('issue:', doc_id, ':', case when lang = 'en' then 'comment' else 'body' end, ':', source, ':', " + hash16("text") + ")")} as issue_id
  from documents""")
sql("version_mentions", with_(cte("issue_items"), select=f"select issue_number, turn, {bar(versions('body'))} as versions from issue_items"))
sql("label_versions", with_(cte("issue_threads"), select=f"""select issue_number, turn, {bar(labelled("label", "milestone"))} as label_versions,
  {bar(f"list_sort(list_distinct(list_concat({labelled('label', 'milestone')}, {versions('body')})))")} as all_versions from issue_threads"""))
sql("pr_refs", with_(cte("issue_items"), select=f"select issue_number, turn, {bar(prs('body'))} as prs from issue_items"))
sql("config_keys", with_(cte("md_docs"), select=f"select doc_id, {bar(configs('content'))} as config_keys from md_docs"))
sql("error_types", with_(cte("log_texts"), select=f"""select event_id, {bar(errors("input"))} as error_types,
  coalesce({errors("input")}[1], '') as error_type from log_texts"""))
sql("is_stacktrace", with_(cte("log_texts"), select=f"select event_id, {stacktrace('input')} as is_stacktrace from log_texts"))
sql("classify_input", with_(cte("log_texts"), input_types("kinds", "log_texts", "event_id", "input"),
    select="select event_id, input_type from kinds"))
sql("json_unwrap", """select event_id, json_extract_string(props, '$.k') as k,
  concat('{"k":["', json_extract_string(props, '$.k'), '"]}') as wrapped from events""")

sql("md_sections", with_(MD_CHUNKS, select=f"""select doc_id, section_no::bigint as section_no, part_no, piece_no, doc_url, doc_section, {bar("path")} as heading_hierarchy,
  content_type, {bar("configs")} as related_configs, md5(content) as content_md5,
  {uuid5("concat(spark_version, ':', doc_url, ':', doc_section, ':', " + hash16("content") + ")")} as chunk_id from md_chunks"""))
_MARKS = f"md_docs as ({VIEWS['mark_docs'].replace('NL', 'chr(10)')})"
ORACLES["md_sections_marks"] = ORACLES["md_sections"].replace(cte("md_docs"), _MARKS)
sql("html_tables_nested", """
select doc_id, 0 as table_no, concat('Key | Value & more', chr(10), 'inx', n_chars, 'y | x', n_chars, ' | y', chr(10), 'x', n_chars, ' | y') as table_text from documents
union all select doc_id, 1, concat('a', doc_id, 'bcd | bcd | d', chr(10), 'd') from documents
union all select doc_id, 2, '' from documents
union all select doc_id, 3, concat('ef | ', lang) from documents""")
sql("heading_path", with_(MD, select=f"""select doc_id, section_no::bigint as section_no, level, heading, {bar("path")} as heading_path
  from md_h join md_paths using (doc_id, section_no)"""))
sql("md_code_blocks", with_(cte("md_docs"), r"""f as (select doc_id, regexp_extract_all(content, '(?ms)^```(\w*)\n(.*?)^```', 2) as blocks from md_docs)""",
    f"u as (select doc_id, unnest(blocks) as b, generate_subscripts(blocks, 1) - 1 as block_no from f)",
    select=f"select doc_id, block_no, {strip('b')} as code from u"))
sql("html_tables", with_(cte("md_docs"), "f as (select doc_id, regexp_extract_all(content, '(?is)<table.*?>.*?</table>') as t from md_docs)",
    "u as (select doc_id, unnest(t) as html, generate_subscripts(t, 1) - 1 as table_no from f)",
    select=f"select doc_id, table_no, {table_text('html')} as table_text from u"))
sql("html_to_text", with_(f"t as (select page_id, {html('html')} as page_text from pages)",
    select="select page_id, length(page_text) as n_chars, md5(page_text) as text_md5 from t"))
sql("include_join", with_(cte("md_docs"), cte("code_files"), INCLUDED,
    select="select doc_id, length(content) as n_chars, md5(content) as content_md5 from md_included"))
sql("top_sections", with_(MD_CHUNKS, select="select doc_section, count(*) as n_chunks from md_chunks group by 1 order by 2 desc, 1 limit 10"))

sql("detect_apis", with_(cte("code_files"), apis("a", "code_files", "p_partkey", "content"),
    select=f"""select p_partkey, {bar("a.apis")} as apis, {bar("a.first_lines")} as first_lines from code_files left join a using (p_partkey)"""))
sql("detect_patterns", with_(cte("code_files"), problems("p", "code_files", "p_partkey", "content"),
    select="""select p_partkey, row_number() over (partition by p_partkey order by rule_no) - 1 as pattern_no, name, risk, description, line, match_text from p"""))
sql("detect_every_rule", with_(cte("rule_texts"), apis("a", "rule_texts", "p_partkey", "content"), problems("p", "rule_texts", "p_partkey", "content"),
    "g as (select p_partkey, list(name order by rule_no) as names, list(line order by rule_no) as nos, list(match_text order by rule_no) as found from p group by 1)",
    select=f"""select p_partkey, {bar("a.apis")} as apis, {bar("a.first_lines")} as api_lines, {bar("names")} as patterns, {bar("nos")} as pattern_lines, {bar("found")} as found,
  {bar(errors("content"))} as error_types from rule_texts left join a using (p_partkey) left join g using (p_partkey)"""))
sql("detect_own_rules", with_(cte("code_files"), apis("a", "code_files", "p_partkey", "content", OWN_APIS), problems("p", "code_files", "p_partkey", "content", OWN_PROBLEMS),
    "g as (select p_partkey, list(concat_ws('/', name, risk, description, line, match_text) order by rule_no) as ps from p group by 1)",
    select=f"""select p_partkey, {bar("a.apis")} as apis, {bar("ps")} as patterns from code_files left join a using (p_partkey) left join g using (p_partkey)"""))
sql("pattern_metadata", with_(cte("code_files"), apis("a", "code_files", "p_partkey", "content"), problems("p", "code_files", "p_partkey", "content"),
    "g as (select p_partkey, list(name order by rule_no) as names, list({'name': name, 'risk': risk, 'description': description} order by rule_no) as ps from p group by 1)",
    select=f"""select p_partkey, {bar("a.apis")} as apis, {bar("names")} as pattern_names, names is not null as has_problems,
  to_json({{'apis': coalesce(a.apis, []), 'patterns': coalesce(ps, [])}})::varchar as pattern_json
  from code_files left join a using (p_partkey) left join g using (p_partkey)"""))
sql("detect_language", """select p_partkey, concat('f', p_partkey, case p_partkey % 4 when 0 then '.py' when 1 then '.scala' else '.java' end) as file_path,
  case p_partkey % 4 when 0 then 'python' when 1 then 'scala' else 'java' end as language from part where p_partkey % 4 <> 3""")
sql("code_units", with_(CODE, apis("ua", "methods", "id", "content"), problems("up", "methods", "id", "content"),
    "ug as (select id, list(name order by rule_no) as names from up group by 1)",
    f"""chunks as (
  select p_partkey, 'imports' as chunk_type, concat('core/src/f', p_partkey, '.py:imports') as qualified_name, '' as signature, 1 as start_line, 0 as end_line, '' as spark_apis, '' as problems,
    string_agg(content, chr(10) order by i) as content from units where kind = 'import' group by 1
  union all select p_partkey, 'class_summary', qualified_name, signature, start_line, end_line, '', '', content from summaries
  union all select m.p_partkey, 'method', m.qualified_name, m.signature, m.i, m.last, {bar("ua.apis")}, {bar("ug.names")}, m.content from methods m left join ua using (id) left join ug using (id))""",
    select=f"""select p_partkey, chunk_type, qualified_name, signature, start_line, end_line, spark_apis, problems, md5(c.content) as content_md5,
  {uuid5("concat(f.spark_version, ':', f.file_path, ':', qualified_name, ':', start_line)")} as chunk_id from chunks c join code_files f using (p_partkey)"""))
sql("code_units_languages", with_(
    cte("unit_files"), "made as (" + "\n union all ".join(_unit(k, i, u) for k, us in _UNITS.items() for i, u in enumerate(us)) + ")",
    "methods as (select * from made where chunk_type = 'method')", apis("ua", "methods", "id", "content"), problems("up", "methods", "id", "content"),
    "ug as (select id, list(name order by rule_no) as names from up group by 1)",
    select=f"""select m.p_partkey, ['python', 'scala', 'java'][(m.p_partkey % 3 + 1)::int] as language, chunk_type, qualified_name, signature, start_line, end_line,
  {bar("ua.apis")} as spark_apis, {bar("ug.names")} as problems, md5(m.content) as content_md5,
  {uuid5("concat(f.spark_version, ':', f.file_path, ':', qualified_name, ':', start_line)")} as chunk_id
  from made m join unit_files f using (p_partkey) left join ua using (id) left join ug using (id)"""))
sql("class_summary", with_(CODE, select="select p_partkey, qualified_name, signature, content, start_line, end_line from summaries"))
sql("split_units", with_(
    f"""t as (select doc_id, concat('def run(self):', chr(10), '        ', replace(text, chr(10), concat(chr(10), '        ')), chr(10), '        return 1') as content from documents)""",
    f"""p as (select doc_id, content, length(content) > 2048 as long, case when length(content) > 2048 then {fold("string_split(content, chr(10))", 1)} else [content] end as pieces from t)""",
    "u as (select doc_id, content, long, pieces, unnest(pieces) as piece, generate_subscripts(pieces, 1) - 1 as part_no from p)",
    select=f"""select doc_id, 'class_summary' as chunk_type, 0 as part_no, concat('D', doc_id) as qualified_name, length(concat('class D', doc_id)) as signature_chars,
  1 as start_line, 1 + len(string_split(content, chr(10))) as end_line,
  md5(concat('class D', doc_id, chr(10), chr(10), 'Methods:', chr(10), '  def run(self)')) as content_md5 from t
  union all select doc_id, 'method', part_no, concat('D', doc_id, '.run', case when len(pieces) > 1 then concat('_part', part_no) else '' end) as qualified_name,
  length(case when not long or (part_no = 0 and len(pieces) > 1) then {signature("content")} else '' end) as signature_chars,
  2 + coalesce(list_sum(list_transform(pieces[1:part_no], lambda x: len(string_split(x, chr(10))))), 0)::bigint as start_line,
  case when long then 0 else 1 + len(string_split(content, chr(10))) end as end_line, md5(piece) as content_md5 from u"""))

sql("qa_chunks", with_(QA, select=f"""select question_id, turn, kind, is_question, score, is_accepted and not is_question as is_accepted, 'apache-spark' as tags,
  coalesce(errs[1], '') as error_type, {bar("apis")} as spark_apis_mentioned, {bar("versions")} as spark_versions_mentioned, md5(content) as content_md5, chunk_id from qa"""))
sql("issue_chunks", with_(ISSUES, select=f"""select issue_number, created_at, coalesce(closed_at, '') as closed_at, state, is_comment, issue_number as parent_issue_number, author, label as labels,
  case when is_comment then {bar(versions("content"))} else {bar(f"list_sort(list_distinct(list_concat({labelled('label', 'milestone')}, {versions('content')})))")} end as spark_versions_mentioned,
  {bar(prs("content"))} as linked_prs, md5(content) as content_md5,
  {uuid5("concat('issue:', issue_number, ':', case when is_comment then 'comment' else 'body' end, ':', author, ':', " + hash16("content") + ")")} as chunk_id from issues"""))
sql("qa_source", with_(cte("qa_threads"), """n as (select question_id, count(*) filter (kind = 'a') as answers, count(*) filter (is_question) as questions from qa_threads group by 1)""",
    select="""select question_id, title, score, answers as answer_count, 1704067200 + question_id * 3600 as last_activity_date
  from qa_threads join n using (question_id) where is_question and answers > 0 and question_id >= 6"""))
sql("qa_nested", with_(QA, "n as (select question_id, count(*) filter (kind = 'a') as answers, count(*) filter (is_question) as questions from qa_threads group by 1)",
    select=f"""select question_id, is_question, score, is_accepted and not is_question as is_accepted, 'apache-spark|join' as tags,
  coalesce(errs[1], '') as error_type, {bar("apis")} as spark_apis_mentioned, {bar("versions")} as spark_versions_mentioned, md5(content) as content_md5, chunk_id
  from qa join n using (question_id) where kind <> 's' and answers > 0 and questions > 0 and question_id >= 6 and question_id % 2 = 0"""))
sql("issue_source", with_(cte("issue_threads"), select="""select issue_number as number, title, state, author as login,
  strftime(make_timestamp((1704067200 + issue_number * 60) * 1000000), '%Y-%m-%dT%H:%M:%SZ') as updated_at
  from issue_threads where turn = 0 and issue_number % 4 <> 0 and state = 'closed'"""))
ORACLES["issue_nested"] = ORACLES["issue_chunks"] + " where issue_number % 4 <> 0"
sql("chunks_per_thread", with_(cte("qa_threads"), select="select question_id, count(*) as n_chunks from qa_threads group by 1"))

_VERSION = "case when doc_id % 2 = 0 then '4.1.0' else '3.5.4' end"
sql("write_read", f"select doc_id, {_VERSION} as spark_version, n_chars from documents where n_chars > 500")
sql("replace_version", f"""select doc_id, {_VERSION} as spark_version, lang as language, md5(case when doc_id % 2 = 0 then concat('new ', text) else text end) as content_md5
  from documents where doc_id % 2 = 1 or doc_id in (select doc_id from labels)""")
sql("upsert_by_id", with_(cte("issue_items"), select="""select issue_number, turn, md5(case when state = 'open' then concat('new ', body) else body end) as body_md5
  from issue_items where state <> 'open' or turn = 0"""))
sql("delete_by_version", "select doc_id, '4.1.0' as spark_version, lang as language from documents where doc_id % 2 = 0")
sql("delete_by_id", with_(cte("issue_items"), select="select issue_number, turn from issue_items where state <> 'open'"))
sql("dedup_chunk_id", f"""select max(doc_id) as doc_id, arg_max(n_chars, doc_id) as n_chars, {uuid5("concat('4.1.0:docs::', " + hash16("text") + ")")} as chunk_id
  from documents group by text""")
sql("incremental_since", f"select event_id, event_type, value from events where ts > timestamp '{SINCE} 00:00:00'")
sql("table_info", with_(cte("qa_threads"), select="""select 'code_chunks' as table_name, true as present, count(*) * 5 as n_rows from part
  union all select 'doc_chunks', true, 0 union all select 'qa_chunks', true, count(*) from qa_threads
  union all select 'issue_chunks', true, count(*) from conversations union all select 'chunk_vectors', false, 0"""))
sql("scan_corpus", with_(cte("code_files"), lines("l", "code_files", "spark_version", "content"),
    select="select spark_version, line, count(*) as n from l where line <> '' group by 1, 2"))

sql("embed_hash", with_(embedded("e", "documents", "doc_id", "text"), select=f"select doc_id, {print_of('vec')} as vec from e"))
_DOC_KEY = uuid5("concat('4.1.0:docs:', doc_id, ':', " + hash16("text") + ")")
sql("embed_fill", with_(embedded("e", "documents", "doc_id", "text"), select=f"""select {_DOC_KEY} as chunk_id, 'emb_hash' as model_column, 64 as dim, {print_of("vec")} as vec
  from documents join e using (doc_id)"""))
sql("merge_embeddings", with_(embedded("e", "documents", "doc_id", "text"), select=f"""select doc_id, {_DOC_KEY} as chunk_id,
  case when doc_id in (select doc_id from labels) then {print_of("vec")} else '' end as vec, doc_id not in (select doc_id from labels) as is_missing from documents join e using (doc_id)"""))
sql("active_model", with_(embedded("e", "benchmark", "item_id", "text", 32), select=f"""select item_id::varchar as chunk_id, 'hash-32' as name, 32 as dim, len(vec) as vec_dim, {print_of("vec")} as vec from e"""))
sql("version_filter", with_(cte("vec_chunks"), select="select vec_id, source, spark_version from vec_chunks c where " + V41))
sql("knn_topk", with_(HELD, nearest("hits", "held_v", "item_id", "vec_facts", 10), select="select item_id, source, vec_id, sim, rank from hits"))
sql("filtered_knn", with_(HELD, nearest("hits", "held_v", "item_id", "vec_facts", 10,
    "(c.source = 'qa' and c.score > 10 and c.is_accepted) or (c.source = 'issues' and c.state = 'closed')"),
    select="select item_id, source, vec_id, sim, rank from hits"))
sql("rerank", with_(SCORED, select=f"select item_id, source, vec_id, rank, {half_up('score', 6)} as score from scored"))
sql("knn_union", with_(SCORED, SERVED, select=f"""select item_id, position, m.source, m.vec_id, {half_up('m.score', 6)} as score, {BESIDE}
  from merged m join served s on s.source = m.source and s.vec_id = m.vec_id"""))
sql("hits_by_source", with_(SCORED, select="select item_id, position, vec_id from merged where source = 'qa'"))

def _cells(name: str, centroids: str) -> str:
    """``name(vec_id, cell)``: the most similar centroid of each vector."""
    return (f"{name} as (select vec_id, cell from (select v.vec_id, c.cell, {cosine('v.u', 'c.u')} as sim from units v cross join {centroids} c) "
            "qualify row_number() over (partition by vec_id order by sim desc, cell) = 1)")


def _moved(name: str, cells: str, centroids: str) -> str:
    """Centroids moved to the means of their vectors; one without vectors stays."""
    return f"""{name}_m as (select cell, list(m order by i) as u from (select cell, i, avg(x) as m from {cells} join parts using (vec_id) group by all) group by cell),
{name} as (select cell, coalesce(m.u, c.u) as u from {centroids} c left join {name}_m m using (cell))"""


sql("ann_index", with_(
    "units as (select vec_id, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) as u from embeddings)",
    "parts as (select vec_id, unnest(u) as x, generate_subscripts(u, 1) - 1 as i from units)",
    "seeds as (select (row_number() over (order by md5(vec_id::varchar)) - 1) as cell, u from units qualify cell < 64)",
    _cells("cells_0", "seeds"), _moved("first", "cells_0", "seeds"), _cells("cells_1", "first"), _moved("second", "cells_1", "first"), _cells("cells_2", "second"),
    "signs as (select b, i, case when substr(md5(concat(b, '/', i)), 1, 1) < '8' then 1 else -1 end as s from (select unnest(range(256)) as b) cross join (select unnest(range(64)) as i))",
    "codes as (select vec_id, list(bit order by b) as code from (select vec_id, b, sum(round(x * 1048576) * s) > 0 as bit from parts join signs using (i) group by all) group by vec_id)",
    f"visits as (select vec_id as item_id, cell from (select v.vec_id, c.cell, {cosine('v.u', 'c.u')} as sim from units v cross join second c where v.vec_id % 50 = 0) qualify row_number() over (partition by vec_id order by sim desc, cell) <= 40)",
    f"""scored as (select q.item_id, c.vec_id, {cosine("a.u", "b.u")} as sim from visits q join cells_2 c using (cell)
  join units a on a.vec_id = q.item_id join units b on b.vec_id = c.vec_id join codes x on x.vec_id = q.item_id join codes y on y.vec_id = c.vec_id
  where len(list_filter(list_zip(x.code, y.code), lambda p: p[1] = p[2])) >= 136)""",
    f"exact as (select item_id, vec_id from (select a.vec_id as item_id, b.vec_id, {cosine('a.u', 'b.u')} as sim from units a cross join units b where a.vec_id % 50 = 0) qualify row_number() over (partition by item_id order by sim desc, vec_id) <= 10)",
    "counts as (select item_id, count(*) as n_scored from scored group by 1)",
    "firsts as (select *, row_number() over (partition by item_id order by sim desc, vec_id) as rank from scored qualify rank <= 10)",
    select="""select item_id, vec_id, sim, rank, e.item_id is not null as in_exact, n_scored, (select count(*) from embeddings) as n_rows
  from firsts f left join exact e using (item_id, vec_id) join counts using (item_id)"""))
sql("json_contains", with_(QA, select="""select question_id, turn, to_json({'apis': apis})::varchar as apis from qa where list_contains(apis, 'DataFrame.collect')"""))


def _longer(column: str, limit: int, by: int = 2000) -> str:
    return f"left(concat({column}, ' ', repeat('x', {by})), {limit})"


def _some(key: str, k: int, column: str, limit: int) -> str:
    return f"case when {key} % 97 = {k} then {_longer(column, limit)} else {column} end"


def _wrapped(key: str, items: str) -> str:
    return f"to_json({{'{key}': {items}}})::varchar"


_ISSUE_VERSIONS = f"case when is_comment then {versions('content')} else list_sort(list_distinct(list_concat({labelled('label', 'milestone')}, {versions('content')}))) end"
sql("serving_export", with_(QA, ISSUES, MD_CHUNKS, cte("unit_files"),
    "made as (" + "\n union all ".join(_unit(k, i, u) for k, us in _UNITS.items() for i, u in enumerate(us)) + ")",
    "methods as (select * from made where chunk_type = 'method')", apis("ua", "methods", "id", "content"), problems("up", "methods", "id", "content"),
    "ug as (select id, list(name order by rule_no) as names from up group by 1)",
    f"""exported as (
  select 'qa_chunks' as table_name, content, to_json({{'question_id': question_id, 'is_question': is_question, 'score': score, 'is_accepted': is_accepted and not is_question,
    'tags': '{{"tags":["apache-spark"]}}', 'error_type': {_longer("coalesce(errs[1], '')", 256)}, 'spark_apis_mentioned': {_wrapped("apis", "apis")},
    'spark_versions_mentioned': {_wrapped("versions", "versions")}}})::varchar as fields from qa
  union all select 'issue_chunks', content, to_json({{'issue_number': issue_number, 'state': {_longer("state", 16)}, 'is_comment': is_comment, 'parent_issue_number': issue_number,
    'author': {_longer("author", 128)}, 'labels': {_wrapped("labels", "[label]")}, 'created_at': {_longer("created_at", 32)}, 'closed_at': {_longer("coalesce(closed_at, '')", 32)},
    'spark_versions_mentioned': {_wrapped("versions", _ISSUE_VERSIONS)}, 'linked_prs': {_wrapped("prs", prs("content"))}}})::varchar from issues
  union all select 'doc_chunks', content, to_json({{'spark_version': spark_version, 'doc_url': {_some("doc_id", 0, "doc_url", 512)}, 'doc_section': {_some("doc_id", 2, "doc_section", 256)},
    'heading_hierarchy': to_json(path)::varchar, 'content_type': content_type, 'related_configs': {_wrapped("configs", "configs")}}})::varchar from md_chunks where spark_version = '4.1.0'
  union all select 'code_chunks', case when m.p_partkey % 97 = 0 then concat(m.content, ' ', repeat('x', 70000)) else m.content end,
    to_json({{'spark_version': f.spark_version, 'file_path': f.file_path, 'language': ['python', 'scala', 'java'][(m.p_partkey % 3 + 1)::int], 'chunk_type': chunk_type,
    'qualified_name': {_some("m.p_partkey", 1, "qualified_name", 512)}, 'signature': {_some("m.p_partkey", 2, "signature", 1024)},
    'spark_apis': {_wrapped("apis", "coalesce(ua.apis, [])")}, 'problem_indicators': {_wrapped("patterns", "coalesce(ug.names, [])")}}})::varchar
    from made m join unit_files f using (p_partkey) left join ua using (id) left join ug using (id) where f.spark_version = '4.1.0')""",
    "texts as (select distinct md5(content) as cid, content from exported where length(content) % 2 = 0)", embedded("e", "texts", "cid", "content"),
    select=f"""select table_name, md5(left(content, 65535)) as content_md5, length(left(content, 65535)) as n_chars, md5(fields) as fields, coalesce({print_of("vec")}, '') as embedding
  from exported left join e on cid = md5(content)"""))

_QUERIES = """q as (select id, input_type, 0 as query_no, input as query_text from parsed
  union all select id, input_type, 1, concat('Spark ', array_to_string(apis[1:5], ' '), ' usage patterns and best practices') from parsed where input_type = 'code' and len(apis) > 0
  union all select id, input_type, 1, concat('Spark ', errs[1], ' cause and fix') from parsed where input_type = 'logs' and len(errs) > 0)"""
sql("expand_queries", with_(ASKED, _QUERIES,
    select="select event_id as request_id, input_type, query_no, query_text from log_texts join q on q.id = md5(input)"))
def _answers(chosen: str) -> str:
    return with_(ASKED, embedded("pv", "parsed", "id", "input"), cte("vec_facts"), SERVED, nearest("hits", "pv", "id", "vec_facts", 10, V41 + chosen),
        f"""scored as (select h.*, {score("p.apis", "'4.1.0'")} as score from hits h join vec_facts f using (vec_id) join parsed p using (id))""",
        f"merged as (select *, {POSITION.format(key='id')} as position from scored qualify position <= 20)",
        select=f"""select event_id as request_id, p.input_type, {bar("p.patterns")} as patterns, {bar("p.errs")} as error_types, '4.1.0' as version, position, m.source, m.vec_id,
  md5(left(s.content, 2000)) as content_md5, {half_up("m.score", 4)} as score, s.metadata, {BESIDE}
  from log_texts l join parsed p on p.id = md5(l.input) join merged m using (id) join served s on s.source = m.source and s.vec_id = m.vec_id""")


sql("analyze_batch", _answers(""))
sql("analyze_two_sources", _answers(" and c.source in ('qa', 'code')"))
_OWN = {"code": {"code": 0.9, "docs": 0.05}, "logs": {"qa": 0.7, "issues": 0.6}}
sql("analyze_all_queries", with_(ASKED, _QUERIES, "qk as (select *, concat(id, '/', query_no) as qid from q)",
    embedded("qv", "qk", "qid", "query_text"), cte("vec_facts"), SERVED,
    "asking as (select event_id, md5(input) as id, ['all', '3.5.4', '4.1.0'][(event_id % 3 + 1)::int] as v from log_texts where event_id % 10 <> 0)",
    f"""near as (select a.id, a.v, k.qid, c.source, c.vec_id, {cosine("e.vec", "c.embedding")} as sim
  from (select distinct id, v from asking) a join qk k using (id) join qv e using (qid) cross join vec_facts c
  where a.v = 'all' or c.source not in ('code', 'docs') or c.spark_version = a.v)""",
    "firsts as (select * from near qualify row_number() over (partition by id, v, qid, source order by sim desc, vec_id) <= 10)",
    "once as (select id, v, source, vec_id, max(sim) as sim from firsts group by all)",
    """hits as (select *, row_number() over (partition by id, v, source order by sim desc, vec_id) as rank from once qualify rank <= 10)""",
    f"""scored as (select h.*, {score("p.apis", "h.v", _OWN)} as score from hits h join vec_facts f using (vec_id) join parsed p using (id))""",
    f"merged as (select *, {POSITION.format(key='id, v')} as position from scored qualify position <= 20)",
    select=f"""select a.event_id as request_id, p.input_type, {bar("p.patterns")} as patterns, {bar("p.errs")} as error_types, a.v as version, position, m.source, m.vec_id,
  md5(left(s.content, 2000)) as content_md5, {half_up("m.score", 4)} as score, s.metadata, {BESIDE}
  from asking a join parsed p using (id) join merged m on m.id = a.id and m.v = a.v join served s on s.source = m.source and s.vec_id = m.vec_id"""))
sql("rejected_requests", """select event_id as request_id, case event_id % 10 when 0 then 3 else -1 end as n_chars from events where event_id % 10 < 2""")
sql("build_context", with_(SCORED, SERVED,
    """shown as (select m.item_id, m.position, m.source, s.content, concat_ws(', ', 'file: ' || s.file_path, 'doc: ' || s.doc_url,
   'SO #' || s.question_id, 'issue #' || s.issue_number, 'v' || s.spark_version) as place from merged m join served s on s.source = m.source and s.vec_id = m.vec_id)""",
    """entries as (select item_id, string_agg(concat('### [', position, '] ', case source when 'code' then 'Code' when 'docs' then 'Docs' when 'qa' then 'Stackoverflow' else 'Issues' end,
   ' (', place, ')', chr(10), '```', chr(10), left(content, 1500), chr(10), '```'), chr(10) order by position) as shown
   from shown where position <= 15 group by 1)""",
    problems("pr", "held", "item_id", "input"),
    "bullets as (select item_id, string_agg(concat('- **', name, '** (', risk, '): ', description), chr(10) order by rule_no) as found from pr group by 1)",
    """texts as (select item_id, concat('## User Input (', input_type, ')', chr(10), chr(10), input, chr(10),
   case when found is null then '' else concat(chr(10), '## Detected Patterns', chr(10), chr(10), found, chr(10)) end,
   case when shown is null then '' else concat(chr(10), '## Retrieved Context', chr(10), chr(10), shown, chr(10)) end,
   chr(10), '## Task', chr(10), chr(10), 'Analyze the user''s input using the retrieved context above. Provide root cause, recommendations, and relevant references.') as context
   from held left join entries using (item_id) left join bullets using (item_id))""",
    select="select item_id as request_id, length(context) as n_chars, md5(context) as context_md5 from texts"))

_CENTRES = f"""parts as (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings),
means as (select label, i, avg(x::double) as m from parts group by all),
centres as (select label::bigint as query_id, list(m order by i) as vec from means group by label),
corpus as (select 'all' as source, vec_id, label, embedding from embeddings),
{nearest("hits", "centres", "query_id", "corpus", 50)},
judged as (select h.*, c.label = h.query_id as relevant from hits h join corpus c using (vec_id)),
sizes as (select label::bigint as query_id, count(*) as n_relevant from embeddings group by 1),
recalls as (select query_id, n_relevant, count(*) filter (relevant and rank <= 10) / n_relevant as recall_10, count(*) filter (relevant and rank <= 50) / n_relevant as recall_50
  from sizes left join judged using (query_id) group by query_id, n_relevant)"""
sql("recall_at_k", with_(_CENTRES, select="select query_id, n_relevant, recall_10, recall_50 from recalls"))
sql("mrr", with_(_CENTRES, "rr as (select query_id, 1.0::double / min(rank) as rr from judged where relevant group by 1)",
    select="select count(*) as n_queries, round(avg(recall_10), 6) as recall_10, round(avg(recall_50), 6) as recall_50, round(avg(coalesce(rr, 0)), 6) as mrr from recalls left join rr using (query_id)"))


def _scores(name: str, dim: int) -> str:
    """``name(model, dataset, n_queries, recall_10, recall_50, mrr)``."""
    return f"""{embedded(name + "_e", "documents", "doc_id", "text", dim)},
{name}_a as (select q.doc_id as q, c.doc_id as c, {cosine("q.vec", "c.vec")} as sim from {name}_e q join fold using (doc_id) join {name}_e c on c.doc_id <> q.doc_id),
{name}_s as (select q, c, case when isnan(sim) then 0 else sim end as sim from {name}_a), -- a text without words
{name}_h as (select *, row_number() over (partition by q order by sim desc, c) as rank from {name}_s qualify rank <= 50),
{name}_j as (select h.q, h.rank, a.lang = b.lang as relevant from {name}_h h join documents a on a.doc_id = h.q join documents b on b.doc_id = h.c),
{name}_q as (select d.doc_id, d.source, count(*) filter (relevant and rank <= 10) / nullif(n - 1, 0) as r10, count(*) filter (relevant) / nullif(n - 1, 0) as r50,
   coalesce(1.0::double / min(rank) filter (relevant), 0) as rr from fold join documents d using (doc_id) join sizes using (lang) left join {name}_j j on j.q = d.doc_id group by d.doc_id, d.source, n),
{name} as (select 'hash-{dim}' as model, source as dataset, count(*) as n_queries, round(avg(r10), 6) as recall_10, round(avg(r50), 6) as recall_50, round(avg(rr), 6) as mrr from {name}_q group by source)"""


sql("evaluate_models", with_("fold as (select doc_id from documents where concat('0x', substr(md5(doc_id::varchar), 1, 8))::bigint % 10 = 0)",
    "sizes as (select lang, count(*) as n from documents group by 1)", _scores("big", 64), _scores("small", 16),
    select="select * from big union all select * from small"))
sql("corpus_stats", """select 'total' as kind, '' as value, count(*) as n_chunks, sum(length(text))::bigint as n_chars, (sum(length(text)) // 4)::bigint as n_tokens from documents
  union all select 'lang', lang, count(*), sum(length(text))::bigint, (sum(length(text)) // 4)::bigint from documents group by lang
  union all select 'source', source, count(*), sum(length(text))::bigint, (sum(length(text)) // 4)::bigint from documents group by source""")
sql("cross_source_version", with_(cte("code_files"), cte("md_docs"), select="""select spark_version, n_code, n_docs from (select spark_version, count(*) as n_code from code_files group by 1) c
  join (select spark_version, count(*) as n_docs from md_docs group by 1) d using (spark_version)"""))
sql("cross_source_api", with_(QA, CODE, apis("ua", "methods", "id", "content"),
    "used as (select unnest(apis) as api from ua)", "names as (select api, count(*) as n_units from used group by 1)",
    "said as (select question_id, score, unnest(apis) as api from qa)",
    select="select api, question_id, score, count(*) as n_messages, n_units from said join names using (api) group by all"))
_LATEST = """select user_id, arg_max(event_id, {'t': ts, 'e': event_id}) as event_id, arg_max(event_type, {'t': ts, 'e': event_id}) as event_type,
  arg_max(value, {'t': ts, 'e': event_id}) as value from events group by 1"""
sql("hwm_sync", _LATEST)
sql("stream_upsert", _LATEST)
