"""Text functions as Column -> Column: masking, places of matches, secrets, sensitive terms."""

from __future__ import annotations

from functools import cache
from re import _constants as R  # the parse tree of patterns, for needed()
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import patterns as P

#: Python's str.strip() and Java's trim differ; these are the characters both sources know.
SPACE = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"


def unicode(pattern: str, ahead: str = "") -> str:
    """pattern with Unicode classes; ahead is what every match begins with, told more cheaply than by the pattern."""
    return f"(?U)(?={ahead})(?:{pattern})" if ahead else f"(?U){pattern}"


def extract(c: str | Column, pattern: Column, group: Column) -> Column:
    """A group of the first match, or an empty string."""
    return F.call_function("regexp_extract", F.col(c) if isinstance(c, str) else c, pattern, group)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def newlines(c: Column) -> Column:
    """How many line feeds c has."""
    return F.char_length(c) - F.char_length(F.replace(c, F.lit("\n"), F.lit("")))


def mask_literals(c: Column) -> Column:
    """c with comments and literals blanked, at the same length and with the same lines."""
    literals = f"(?=[/\"'])(?:{P.LITERALS})"  # a look at one character spares most places the alternatives
    blank = F.transform(F.regexp_extract_all(c, F.lit(literals), F.lit(0)), lambda m: F.regexp_replace(m, F.lit(r"[^\n]"), F.lit(" ")))
    return F.array_join(F.zip_with(F.split(c, literals, -1), blank, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


PLACES = "array<struct<at:int,line:int,part:string>>"


def raw(pattern: str) -> str:
    """A pattern as an SQL literal in which backslashes stand for themselves."""
    if "'" in pattern:
        raise ValueError("a pattern with an apostrophe needs another literal")
    return f"r'{pattern}'"


@cache
def needed(pattern: str) -> tuple[str, ...]:
    """Texts of which every match of pattern holds one, or () if none can be told."""
    try:
        tree = _parser.parse(pattern.removeprefix("(?U)").replace(r"\z", r"\Z"))
    except _parser.error:  # what only Java reads
        return ()
    return () if tree.state.flags & R.SRE_FLAG_IGNORECASE else _needed(tree)


def _needed(tree) -> tuple[str, ...]:
    options, run = [], ""
    for op, arg in [*tree, (None, None)]:
        if op is R.LITERAL:
            run += chr(arg)
            continue
        if run:
            options.append((run,))
            run = ""
        if op is R.SUBPATTERN and not arg[1]:
            options.append(_needed(arg[3]))
        elif op in (R.MAX_REPEAT, R.MIN_REPEAT, R.POSSESSIVE_REPEAT) and arg[0] > 0:
            options.append(_needed(arg[2]))
        elif op is R.BRANCH:
            each = [_needed(b) for b in arg[1]]
            options.append(tuple(w for words in each for w in words) if all(each) else ())
    best = max(options, key=lambda words: min(map(len, words), default=0), default=())
    return tuple(w for w in dict.fromkeys(best) if not any(v != w and v in w for v in best)) if " " not in "".join(best) else ()


def may_match(c: str, pattern: str) -> str:
    """SQL: whether c holds a text that every match of pattern needs; plain searches cost a fraction of the pattern's."""
    words = needed(pattern)
    return "({})".format(" OR ".join(f"contains({c}, {raw(w)})" for w in words)) if words else f"{c} RLIKE {raw(pattern)}"


def dense(c: str) -> str:
    """SQL: c without most of its spaces, for may_match; words stay whole."""
    return f"replace(replace({c}, '    ', ''), '  ', '')"


def places_sql(c: str, pattern: str, dense: str | None = None) -> str:
    """SQL: all matches of pattern in c, leftmost first and without overlap: array of (at, line, part).

    at counts characters from 0 and line line feeds before it; part is the text
    from the match to the next one. Texts without what a match needs cost plain
    searches only, in dense(c) where that is at hand.
    """
    rx = raw(pattern)
    # Gaps and matches are paired, so no character of the text can be taken for a mark.
    parts = f"zip_with(split({c}, {rx}, -1), concat(array(''), regexp_extract_all({c}, {rx}, 0)), (g, m) -> concat(m, g))"
    fold = f"""aggregate({parts},
        named_struct('at', 0, 'line', 0, 'out', CAST(array() AS {PLACES})),
        (s, p) -> named_struct(
            'at', s.at + char_length(p), 'line', s.line + (char_length(p) - char_length(replace(p, chr(10), ''))),
            'out', concat(s.out, array(named_struct('at', s.at, 'line', s.line, 'part', p)))),
        s -> slice(s.out, 2, size(s.out)))"""
    # The first part lies before any match, so it is left out.
    return f"CASE WHEN {may_match(dense if dense and needed(pattern) else c, pattern)} THEN {fold} ELSE CAST(array() AS {PLACES}) END"


def places(column: str, pattern: str) -> Column:
    return F.expr(places_sql(column, pattern))


def closing(c: Column, pair: str) -> Column:
    """In c, which begins with an opening character, the offset of the one that closes it; else of the last character."""
    open_, close = pair
    parts = F.split(c, rf"(?=[\{open_}\{close}])", -1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("done"))

    def step(s: Column, part: Column) -> Column:
        depth = s["depth"] + F.when(F.startswith(part, F.lit(open_)), 1).when(F.startswith(part, F.lit(close)), -1).otherwise(0)
        ends = (s["done"] < 0) & F.startswith(part, F.lit(close)) & (depth == 0)
        return F.struct(depth.alias("depth"), (s["at"] + F.char_length(part)).alias("at"), F.when(ends, s["at"]).otherwise(s["done"]).alias("done"))

    folded = F.aggregate(parts, start, step, lambda s: F.when(s["done"] >= 0, s["done"]).otherwise(F.char_length(c) - 1))
    # Where no other opening character comes before the first closing one, that one closes.
    first, inner = F.locate(close, c), F.locate(open_, c, 2)
    return F.when((first > 0) & ((inner == 0) | (inner > first)), first - 1).otherwise(folded)


def snippet(body: Column, line: Column, most: int = 240) -> Column:
    """The stripped text of a line (from 0) of body, at most so long."""
    return F.left(strip(F.coalesce(F.get(F.split(body, "\n", -1), line), F.lit(""))), F.lit(most))


def mask_secrets(c: Column) -> Column:
    for pattern, new in P.SECRETS:
        c = F.regexp_replace(c, F.lit(pattern), F.lit(new))
    return c


def sensitive_terms(c: Column) -> Column:
    """Distinct sensitive terms of c in lower case, sorted; a null text has none."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(unicode(P.SENSITIVE)), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def is_sensitive_log(message: Column, rest: Column) -> Column:
    blob = F.concat_ws(" ", message, rest)
    return F.rlike(blob, F.lit(unicode(P.SENSITIVE))) | F.rlike(strip(rest), F.lit(unicode(P.WHOLE_OBJECT)))


def safe_fields(fields: Column) -> Column:
    return F.filter(fields, lambda f: ~F.rlike(f, F.lit(unicode(P.SENSITIVE))))


def rejected_fields(fields: Column) -> Column:
    return F.filter(fields, lambda f: F.rlike(f, F.lit(unicode(P.SENSITIVE))))


def do_not_log(extras: Column, rejected: Column, most: int = 8) -> Column:
    """The fixed list, then further entries that differ from all before by more than case and spaces."""
    def put(acc: Column, x: Column) -> Column:
        key = F.lower(strip(x))
        known = F.exists(acc, lambda y: F.lower(strip(y)) == key)
        return F.when(known | (key == ""), acc).otherwise(F.concat(acc, F.array(x)))

    first = F.array(*map(F.lit, P.DO_NOT_LOG))
    return F.slice(F.aggregate(F.concat(extras, rejected), first, put), 1, most)


def code_window(source: Column, start: Column, end: Column, focus: Column, around: int = 12) -> Column:
    """Numbered lines around focus within start to end (lines from 1), secrets masked."""
    lines = F.split(F.regexp_replace(source, "\r\n|\r", "\n"), "\n", -1)
    lo, hi = F.greatest(F.lit(1), start, focus - around), F.least(F.size(lines), end, focus + around)
    numbers = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    return mask_secrets(F.array_join(F.transform(numbers, lambda n: F.format_string("%5d| %s", n, F.get(lines, n - 1))), "\n"))


def letters_only(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


def unfold(df: DataFrame, keep: list, column: str | Column, name: str = "x") -> DataFrame:
    """A row for each element of an array, with the kept columns.

    The outer form is used and nulls dropped after it, because for the plain form
    the optimizer adds a filter on the array's size that computes the array again.
    """
    return df.select(*keep, F.explode_outer(column).alias(name)).where(F.col(name).isNotNull())
