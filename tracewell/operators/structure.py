"""From source files to methods: one narrow pass over each file, without a shuffle.

The masked text is split before each brace and parenthesis. One fold over these
parts keeps a stack of parentheses and one of braces; a brace that follows a
closed parameter list may open a method, one after a type declaration a type,
and the closing brace completes both. The fold's state holds only the places of
what is open and of what was found; names are read afterwards from the texts
before the parameter lists that a brace follows. Every file is a row of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import patterns as P
from tracewell.functions import text as T

_NAME = r"(?U)[A-Za-z_$][\w$]*\s*\z"
_THROWS = r"(?U)\A\)\s*(?:throws\s+([\w.,\s]+?))?\s*\z"
_DELIMITED = r"(?s)\A(?:.*;|[{}()])"
_BEFORE = r"(?U)[A-Za-z_$][\w$<>\[\].,?\s]*\z"
_RETURN = r"(?U)([\w$][\w$<>\[\],.?\s]*?)\s*\z"
_TYPE = r"(?U)(?=[cier])\b(class|interface|enum|record)\s+([A-Za-z_$][\w$]*)"
_TYPE_LIST = "array<struct<at:int,kind:string,name:string>>"


def _words(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _strip(c: str) -> str:
    return f"btrim({c}, {T.raw(T.SPACE)})"


# The fold keeps places only; names are read from the text of the few parts that matter.
#: Each part with its first character's code, and whether a type may be declared in it.
_PARTS = f"""transform(_split, (p, i) -> named_struct('ch', ascii(p), 'len', char_length(p),
  'lines', char_length(p) - char_length(replace(p, chr(10), '')),
  'typed', contains(p, 'class') OR contains(p, 'interface') OR contains(p, 'enum') OR contains(p, 'record'),
  'opens', CASE WHEN ascii(p) = 41 AND ascii(get(_split, i + 1)) = 123 AND char_length(p) <= 400 THEN p RLIKE {T.raw(_THROWS)} ELSE false END))"""

#: A parameter list: part and place of the text before it, its bounds and the part that follows it.
_LIST = "struct<part:int,at:int,line:int,from:int,to:int,after:int>"
_BRACE = f"struct<open:int,line:int,since:int,typed:boolean,m:{_LIST}>"
_FOUND = f"struct<m:{_LIST},open:int,body_line:int,close:int,end_line:int>"
_SPAN = "struct<since:int,open:int,close:int>"


def _state(**changes: str) -> str:
    """The fold's next state after a part; what is not named stays, but done, which holds for one part."""
    state = {
        "i": "s.i + 1", "at": "s.at + p.len", "line": "s.line + p.lines", "since": "s.since", "typed": "s.typed OR p.typed",
        "before_at": "s.at", "before_line": "s.line", "done": f"CAST(NULL AS {_LIST})",
        "parens": "s.parens", "braces": "s.braces", "methods": "s.methods", "types": "s.types",
    } | changes
    return "named_struct({})".format(", ".join(f"'{k}', {v}" for k, v in state.items()))


def _on(character: str, **changes: str) -> str:
    return f"WHEN p.ch = {ord(character)} THEN {_state(**changes)}"


# s is the state and p the part; the first character of p stands at s.at on line s.line (from 0).
_TOP = "element_at(s.braces, -1)"
_FOLD = f"""
aggregate(_parts,
  named_struct('i', 0, 'at', 0, 'line', 0, 'since', 0, 'typed', false, 'before_at', 0, 'before_line', 0, 'done', CAST(NULL AS {_LIST}),
    'parens', CAST(array() AS array<{_LIST}>), 'braces', CAST(array() AS array<{_BRACE}>),
    'methods', CAST(array() AS array<{_FOUND}>), 'types', CAST(array() AS array<{_SPAN}>)),
  (s, p) -> CASE
    {_on('(', parens="concat(s.parens, array(named_struct('part', s.i - 1, 'at', s.before_at, 'line', s.before_line, 'from', s.at + 1, 'to', 0, 'after', 0)))")}
    {_on(')',
            done=f"""CASE WHEN p.opens AND size(s.parens) > 0 THEN transform(slice(s.parens, -1, 1), m -> named_struct('part', m.part, 'at', m.at,
                'line', m.line, 'from', m.from, 'to', s.at, 'after', s.i))[0] END""",
            parens="CASE WHEN size(s.parens) > 0 THEN slice(s.parens, 1, size(s.parens) - 1) ELSE s.parens END")}
    {_on('{', since="s.at", typed="p.typed",
            braces="concat(s.braces, array(named_struct('open', s.at, 'line', s.line, 'since', s.since, 'typed', s.typed, 'm', s.done)))")}
    {_on('}',
            braces="CASE WHEN size(s.braces) > 0 THEN slice(s.braces, 1, size(s.braces) - 1) ELSE s.braces END",
            methods=f"""CASE WHEN size(s.braces) > 0 AND {_TOP}.m IS NOT NULL THEN concat(s.methods, array(named_struct('m', {_TOP}.m, 'open', {_TOP}.open,
                'body_line', {_TOP}.line, 'close', s.at, 'end_line', s.line))) ELSE s.methods END""",
            types=f"""CASE WHEN size(s.braces) > 0 AND {_TOP}.typed THEN concat(s.types, array(named_struct('since', {_TOP}.since, 'open', {_TOP}.open,
                'close', s.at))) ELSE s.types END""")}
    ELSE {_state()} END,
  s -> named_struct(
    'methods', concat(s.methods, transform(filter(s.braces, b -> b.m IS NOT NULL), b -> named_struct('m', b.m, 'open', b.open,
        'body_line', b.line, 'close', s.at - 1, 'end_line', s.line))),
    'types', concat(s.types, transform(filter(s.braces, b -> b.typed), b -> named_struct('since', b.since, 'open', b.open, 'close', s.at - 1)))))
"""

# What stands before a parameter list, in steps so that each text is searched once.
#: The text before it, from the last bracket or semicolon on.
_STEP_1 = f"""transform(_found.methods, x -> named_struct('x', x, 'p', CASE WHEN x.m.part < 0 THEN '' ELSE _split[x.m.part] END))"""
#: The name that ends it.
_STEP_2 = f"""transform(_p1, x -> named_struct('x', x.x, 'p', x.p, 'tail', regexp_extract(x.p, {T.raw(_NAME)}, 0)))"""
#: What stands before the name.
_STEP_3 = f"""transform(filter(_p2, x -> x.tail <> ''), x -> named_struct('x', x.x, 'p', x.p, 'name_at', char_length(x.p) - char_length(x.tail),
  'name', {_strip('x.tail')},
  'before', {_strip(f"right(regexp_replace(left(x.p, char_length(x.p) - char_length(x.tail)), {T.raw(_DELIMITED)}, ''), 120)")}))"""
#: The names that may be a method's.
_STEP_4 = f"""filter(_p3, x -> x.before <> '' AND x.name NOT IN ({_words((*P.KEYWORDS, *P.MODIFIERS))}) AND x.before RLIKE {T.raw(_BEFORE)}
          AND NOT endswith(x.before, '.') AND NOT endswith(x.before, '=') AND NOT endswith(x.before, 'return'))"""
_RETURNED = f"""array_join(filter(split(regexp_extract(regexp_replace(x.before, {T.raw(r'(?U)\s+')}, ' '), {T.raw(_RETURN)}, 1), ' '),
    w -> w <> '' AND w NOT IN ({_words(P.MODIFIERS)})), ' ')"""
_METHODS = f"""array_sort(transform(_p4, x -> named_struct(
  'at', x.x.m.at + x.name_at,
  'line', x.x.m.line + char_length(left(x.p, x.name_at)) - char_length(replace(left(x.p, x.name_at), chr(10), '')),
  'name', x.name, 'ret', coalesce(nullif({_RETURNED}, ''), 'void'), 'from', x.x.m.from, 'to', x.x.m.to,
  'throws', {_strip(f"regexp_extract(_split[x.x.m.after], {T.raw(_THROWS)}, 1)")} <> '',
  'open', x.x.open, 'body_line', x.x.body_line, 'close', x.x.close, 'end_line', x.x.end_line)))"""
#: Each declaration belongs to the next brace; one without a brace is none.
_TYPES = f"""array_sort(filter(transform({T.places_sql('masked', _TYPE)}, t -> named_struct('at', t.at,
    'kind', regexp_extract(t.part, {T.raw(_TYPE)}, 1), 'name', regexp_extract(t.part, {T.raw(_TYPE)}, 2),
    'close', get(filter(_found.types, b -> b.since <= t.at AND t.at < b.open), 0).close)), t -> t.close IS NOT NULL))"""


def files(sources: DataFrame) -> DataFrame:
    """Parsed files of (path, content, ...): masked text, hash, package, imports, types and methods.

    Further columns of sources stay. A null content counts as empty.
    """
    content = F.coalesce("content", F.lit(""))
    low = F.lower("path")
    df = sources.withColumn("content", content).withColumn("masked", T.mask_literals(F.col("content")))
    df = df.withColumns({
        "file_hash": F.sha2("content", 256),
        "line_count": T.newlines(F.col("content")) + 1,
        "is_test": F.contains("path", F.lit("/src/test/")) | F.endswith(low, F.lit("test.java")) | F.endswith(low, F.lit("tests.java")),
        "package": F.nullif(T.extract("masked", F.lit(r"(?mU)^[^\S\n]*+package\s+([\w.]+)\s*;"), F.lit(1)), F.lit("")),
        "imports": F.regexp_extract_all("masked", F.lit(r"(?mU)^[^\S\n]*+import\s+(?:static\s+)?([\w.*]+)\s*;"), F.lit(1)),
        "_split": F.split("masked", r"(?=[{}()])", -1),
    })
    steps = (("_parts", _PARTS), ("_found", _FOLD), ("_p1", _STEP_1), ("_p2", _STEP_2), ("_p3", _STEP_3), ("_p4", _STEP_4), ("_methods", _METHODS), ("types", _TYPES))
    for name, step in steps:
        df = df.withColumn(name, F.expr(step))
    df = df.drop("_split", "_parts", "_found", "_p1", "_p2", "_p3", "_p4")
    named = lambda *kinds: F.transform(F.filter("types", lambda t: t["kind"].isin(*kinds)), lambda t: t["name"])
    return df.withColumns({"classes": named("class", "enum", "record"), "interfaces": named("interface")})


def _parameters(c: Column) -> Column:
    parts = F.split(T.strip(c), r",(?![^<>()]*[>)])", -1)
    clean = F.transform(parts, lambda p: T.strip(F.regexp_replace(
        T.strip(F.regexp_replace(p, F.lit(r"(?U)\s+"), F.lit(" "))), F.lit(r"(?U)\A(final|@\w+(\([^)]*\))?)\s+"), F.lit(""))))
    return F.filter(clean, lambda p: p != "")


def methods(parsed: DataFrame) -> DataFrame:
    """One row per method of files(): names, lines, signature, and its raw and masked body."""
    keep = [c for c in parsed.columns if c not in ("_methods", "types", "classes", "interfaces", "imports", "package", "content", "masked", "line_count")]
    rows = parsed.select(
        *keep, "content", "masked", "types",
        F.exists("imports", lambda i: F.contains(i, F.lit("org.apache.spark"))).alias("spark_import"),
        F.posexplode_outer("_methods").alias("method_ord", "m")).where(F.col("m").isNotNull())
    inside = F.filter("types", lambda t: (t["at"] <= F.col("m.at")) & (F.col("m.at") <= t["close"]))
    best = F.array_sort(F.transform(inside, lambda t: F.struct((t["close"] - t["at"]).alias("size"), t["at"].alias("at"), t["name"].alias("name"))))
    rows = rows.withColumn("class_name", F.coalesce(F.get(best, F.lit(0))["name"], F.lit("<anonymous>")))
    span = F.col("m.close") - F.col("m.open") + 1
    head = F.greatest(F.lit(0), F.col("m.at") - 400)
    return rows.select(
        *keep, "spark_import", "method_ord", F.col("m.name").alias("name"), "class_name",
        (F.col("m.line") + 1).alias("start_line"), (F.col("m.end_line") + 1).alias("end_line"), (F.col("m.body_line") + 1).alias("body_line"),
        F.when(F.col("m.name") == F.col("class_name"), "<constructor>").otherwise(F.col("m.ret")).alias("return_type"),
        _parameters(F.substring("content", F.col("m.from") + 1, F.col("m.to") - F.col("m.from"))).alias("parameters"),
        F.regexp_extract_all(F.substring("masked", head + 1, F.col("m.at") - head), F.lit(r"(?U)@([A-Za-z_$][\w$.]*)"), F.lit(1)).alias("annotations"),
        F.col("m.throws").alias("throws"),
        F.substring("content", F.col("m.open") + 1, span).alias("body"), F.substring("masked", F.col("m.open") + 1, span).alias("masked_body"),
    )
