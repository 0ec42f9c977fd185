"""Personal data by weak supervision, in DataFrame operations only.

Base spans (e-mail addresses, IP addresses, card and phone numbers) follow fixed
patterns and always stay. Looser patterns propose further spans: written-out
e-mail addresses, telephone numbers without a country code, and numbers that fail
the checksum where the words before them speak of a card. Three labelers vote on every span, base or not:

* shape: a stricter regular expression or checksum;
* gazetteer: known top-level domains, issuer prefixes, number plans;
* context: telling words in the CONTEXT characters before the span.

Votes are 0 (against), 1 (none) or 2 (for). Expectation-maximisation over the
counts of vote patterns, with base spans known to be true, estimates for each
kind how often a labeler votes so on true and on false spans (its reliability)
and each pattern's probability. A naive Bayes classifier of the spans' features
(votes, length, the character before) is then fitted to these probabilities, and
keeps the further spans that it gives KEEP or more and that touch no base span.

The corpus is aggregated to the counts of feature patterns, of which there are at
most 4 kinds * 2 * 27 votes * 8 lengths * 4 characters = 6,912, whatever its size.

Offsets count code points, ends are exclusive. A null or empty text has no spans.
Repeated rows are treated alike; rows may lack an id. An empty table gives an
empty result, and columns besides the text and the id are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, whole_rows

KINDS = ("email", "ip", "card", "phone")
CONTEXT, KEEP, ROUNDS = 40, 0.5, 25

# The patterns of the base spans, with possessive repeats where giving back can't help and with
# starts only where a leftmost match can start, so that long runs cost linear time.
_BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_MORE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[({]\x20?at\x20?[\])}]\x20?[A-Za-z0-9-]{1,63}+"
             r"(?:(?:\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\.)[A-Za-z0-9-]{1,63}+){1,4}+",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
# Fixed word lists of the labelers.
_DOMAINS = "com|org|net|edu|gov|int|info|biz|io|eu|de|fr|es|it|nl|uk|us|ca|ch|at|be|pl|pt|se|no|fi|dk|ie|au|nz|jp|in|br|mx"
_ISSUERS = r"^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3[068][0-9]{12}|6(?:011|5[0-9]{2})[0-9]{12}|35[0-9]{14})$"
_WORDS = {
    "email": ("e-?mail|mail|contact|write|reach|adresse|correo", "example"),
    "ip": ("ip|host|server|address|client|login|adresse", "version|release|section|build|chapter"),
    "card": ("card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta", "order|isbn|invoice|serial|tracking|id|ref"),
    "phone": ("phone|tel|call|fax|mobile|cell|whatsapp|telefon|telefono", "order|isbn|invoice|serial|ref"),
}


def _spans(text: Column, kind: str, base: bool, pattern: str, guard: Column) -> Column:
    """Matches of a pattern in text as an array of (kind, base, s, e, m, before)."""
    empty = "array<struct<kind:int,base:boolean,s:int,e:int,m:string,before:string>>"
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def put(acc: Column, z: Column) -> Column:
        start = acc["at"] + F.char_length(z["gap"])
        end = start + F.coalesce(F.char_length(z["m"]), F.lit(0))
        before = F.right(F.concat(acc["tail"], z["gap"]), F.lit(CONTEXT))
        one = F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.lit(base).alias("base"), start.alias("s"), end.alias("e"),
                       z["m"].alias("m"), before.alias("before"))
        return F.struct(end.alias("at"), F.right(F.concat(before, F.coalesce(z["m"], F.lit(""))), F.lit(CONTEXT)).alias("tail"), F.when(z["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(one))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(empty).alias("out"))
    return F.when(guard, F.aggregate(pairs, start, put, lambda acc: acc["out"])).otherwise(F.array().cast(empty))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _part_ok(p: Column) -> Column:
    p = F.regexp_replace(p, "^0+", "")
    return (F.length(p) < 3) | ((F.length(p) == 3) & (p <= F.lit("255")))


def _valid(kind: str, x: Column) -> Column:
    m = x["m"]
    n = F.length(_digits(m))
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: F.forall(F.split(m, r"\."), _part_ok),
        "card": lambda: n.between(13, 19) & F.call_function("luhn_check", _digits(m)),
        "phone": lambda: n.between(9, 15),
    }[kind]()


def _validator(kind: str) -> Callable[[Column], Column]:
    return lambda x: _valid(kind, x)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 2).when(no, 0).otherwise(1).cast("int")


def _described(x: Column) -> Column:
    """A span with its votes and features instead of its text."""
    m, before, kind = x["m"], F.lower(x["before"]), x["kind"]
    digits = _digits(m)

    def by_kind(**made: Column) -> Column:
        out = F.when(kind == KINDS.index("email"), made["email"])
        for k in KINDS[1:-1]:
            out = out.when(kind == KINDS.index(k), made[k])
        return out.otherwise(made[KINDS[-1]])

    shape = by_kind(
        email=F.when(m.rlike(r"\.[A-Za-z]{2,}$") | m.rlike(r"(?i)dot\x20?[\])}]\x20?[a-z]{2,}$"), 2).otherwise(0),
        ip=F.when(F.forall(F.split(m, r"\."), lambda p: _part_ok(p) & ~p.rlike("^0[0-9]")), 2).otherwise(0),
        card=F.when(F.call_function("luhn_check", digits) & F.length(digits).between(13, 19), 2).otherwise(0),
        phone=_vote(m.rlike(r"^\+?[0-9]{0,3}\x20?\([0-9]{2,4}\)\x20?[0-9]{3}[\x20.-][0-9]{3,4}$"), ~F.length(digits).between(9, 15)),
    )
    known = by_kind(
        email=F.when(F.lower(m).rlike(rf"(?:\.|[\])}}]\x20?)(?:{_DOMAINS})$"), 2).otherwise(0),
        ip=_vote(m.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\."), m.rlike(r"^0+\.|^2[3-9][0-9]\.")),
        card=F.when(digits.rlike(_ISSUERS), 2).otherwise(0),
        phone=_vote(m.rlike(r"^\+[1-9]") | digits.rlike(r"^[2-9][0-9]{2}[2-9][0-9]{6}$"), m.rlike(r"^\+0")),
    )
    told = by_kind(**{k: _vote(before.rlike(rf"\b(?:{yes})\b[^\n]*$"), before.rlike(rf"\b(?:{no})\b[^\n]*$")) for k, (yes, no) in _WORDS.items()})
    last = F.right(x["before"], F.lit(1))
    edge = F.when(last == "", 0).when(last.rlike(r"[A-Za-z0-9]"), 1).when(last.rlike(r"\s"), 2).otherwise(3)
    return F.struct(
        kind, x["base"].alias("base"), x["s"].alias("s"), x["e"].alias("e"),
        shape.alias("v1"), known.alias("v2"), told.alias("v3"),
        F.least(F.lit(7), (F.length(m) / 4).cast("int")).alias("len"), edge.cast("int").alias("edge"),
    )


def candidates(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with two columns of spans, base and further ones: kind, base, s, e and features."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    guards = {
        "email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")),
        "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"),
    }
    found = {k: _spans(text, k, True, _BASE[k], guards[k]) for k in KINDS}
    more = {
        "email": _spans(text, "email", False, _MORE["email"], text.rlike(r"(?i)[\[({]\x20?at\x20?[\])}]")),
        "phone": _spans(text, "phone", False, _MORE["phone"], text.rlike(r"[0-9]{3}[\x20.-][0-9]{4}")),
    }
    # A card-like run is matched once: with a good checksum it is a base span, else a further one.
    tested = F.transform(found["card"], lambda x: x.withField("base", _valid("card", x)))
    kept = [F.filter(found[k], _validator(k)) for k in ("email", "ip", "phone")]
    raw = F.concat(kept[0], kept[1], tested, kept[2], more["email"], more["phone"])
    out = df.withColumn("_raw", F.transform(raw, _described))
    return (
        out.withColumn("_base", F.filter("_raw", lambda x: x["base"]))
        .withColumn("_more", F.filter("_raw", lambda x: ~x["base"] & ((x["kind"] != KINDS.index("card")) | (x["v3"] == 2))))
        .withColumn("_more", F.filter("_more", lambda x: ~F.exists("_base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))))
        .drop("_raw")
    )


_FEATURES = ("v1", "v2", "v3", "len", "edge")

# Prior counts of votes against, none and for: on false spans, then on true ones; the same for each labeler.
_PRIOR = "array(6D, 3D, 1D, 1D, 3D, 6D)"


def _em_step(posts: str) -> str:
    """SQL: the patterns after one maximisation and one expectation. Place k of t is class k / 9, labeler k / 3 % 3, vote k % 3."""
    side = "CASE WHEN k >= 9 THEN q.w ELSE 1D - q.w END"
    table = f"""transform(sequence(0, 17), k -> (
        element_at({_PRIOR}, (k div 9 * 3 + k % 3 + 1)::int)
        + aggregate({posts}, 0D, (a, q) -> a + q.n * ({side})
            * CASE WHEN element_at(array(q.v1, q.v2, q.v3), (k div 3 % 3 + 1)::int) = k % 3 THEN 1D ELSE 0D END))
        / (10D + aggregate({posts}, 0D, (a, q) -> a + q.n * ({side}))))"""
    share = f"(1D + aggregate({posts}, 0D, (a, q) -> a + q.n * q.w)) / (2D + aggregate({posts}, 0D, (a, q) -> a + q.n))"
    true = "m.share * m.t[9 + p.v1] * m.t[12 + p.v2] * m.t[15 + p.v3]"
    false = "(1D - m.share) * m.t[p.v1] * m.t[3 + p.v2] * m.t[6 + p.v3]"
    return f"""flatten(transform(array(named_struct('t', {table}, 'share', {share})), m ->
        transform({posts}, p -> named_struct('v1', p.v1, 'v2', p.v2, 'v3', p.v3, 'base', p.base, 'n', p.n,
            'w', CASE WHEN p.base THEN 1D ELSE ({true}) / ({true} + {false}) END))))"""


def vote_probabilities(patterns: DataFrame) -> DataFrame:
    """(kind, base, v1, v2, v3, w): the probability of each vote pattern by expectation-maximisation."""
    first = "CASE WHEN base THEN 1D WHEN v1 + v2 + v3 >= 5 THEN 0.9D WHEN v1 + v2 + v3 = 4 THEN 0.5D ELSE 0.1D END"
    votes = patterns.groupBy("kind", "base", "v1", "v2", "v3").agg(F.sum("n").cast("double").alias("n"))
    # At most 54 patterns of each kind are gathered.
    rows = votes.groupBy("kind").agg(F.sort_array(F.collect_list(F.expr(
        f"named_struct('v1', v1, 'v2', v2, 'v3', v3, 'base', base, 'n', n, 'w', {first})"))).alias("posts"))
    ended = rows.select("kind", F.expr(f"aggregate(sequence(1, {ROUNDS}), posts, (s, i) -> {_em_step('s')})").alias("posts"))
    return ended.select("kind", F.explode("posts").alias("p")).select("kind", "p.base", "p.v1", "p.v2", "p.v3", "p.w")


def classifier(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, v1, v2, v3, len, edge, p): the fitted probability of each pattern of further spans."""
    spans = candidates(df.select(text_col), text_col).select(F.explode(F.concat("_base", "_more")).alias("x")).select("x.*")
    patterns = spans.groupBy("kind", "base", *_FEATURES).agg(F.count("*").alias("n"))
    # Read twice below; the table is small (see above), reading the corpus is not.
    patterns = durable(patterns)
    soft = patterns.join(F.broadcast(vote_probabilities(patterns)), ["kind", "base", "v1", "v2", "v3"])
    classes = soft.groupBy("kind").agg(F.sum(F.col("n") * F.col("w")).alias("t"), F.sum(F.col("n") * (1 - F.col("w"))).alias("f"))
    features = F.explode(F.array(*[F.struct(F.lit(k).alias("j"), F.col(k).alias("value")) for k in _FEATURES])).alias("x")
    each = soft.select("kind", "n", "w", features).groupBy("kind", "x.j", "x.value").agg(
        F.sum(F.col("n") * F.col("w")).alias("jt"), F.sum(F.col("n") * (1 - F.col("w"))).alias("jf"))
    odds = each.join(F.broadcast(classes), "kind").select(
        "kind", "j", "value", (F.log((F.col("jt") + 1) / (F.col("t") + 8)) - F.log((F.col("jf") + 1) / (F.col("f") + 8))).alias("odds"))
    prior = classes.select("kind", (F.log(F.col("t") + 1) - F.log(F.col("f") + 1)).alias("prior"))
    asked = patterns.where(~F.col("base")).select("kind", *_FEATURES).distinct()
    scored = asked.select("kind", *_FEATURES, features).select("kind", *_FEATURES, "x.j", "x.value").join(F.broadcast(odds), ["kind", "j", "value"])
    total = scored.groupBy("kind", *_FEATURES).agg(F.sum("odds").alias("odds")).join(F.broadcast(prior), "kind")
    return total.select("kind", *_FEATURES, (1 / (1 + F.exp(-(F.col("odds") + F.col("prior"))))).alias("p"))


def _code(x: Column) -> Column:
    code = x["kind"]
    for k in _FEATURES:
        code = code * 10 + x[k]
    return code


def find_spans(df: DataFrame, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """df with base and spans: arrays of (kind, s, e), by kind as in KINDS, then by start."""
    code = F.col("kind")
    for k in _FEATURES:
        code = code * 10 + F.col(k)
    # The fitted classifier is a set of accepted patterns, bounded as said above.
    accepted = [r["code"] for r in classifier(df, text_col).where(F.col("p") >= keep).select(code.alias("code")).distinct().orderBy("code").collect()]
    plain = lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))
    more = F.col("_more") if accepted else F.slice("_more", 1, 0)
    if accepted:
        more = F.filter(more, lambda x: _code(x).isin(accepted))
    return (
        candidates(df, text_col)
        .withColumn("base", F.transform("_base", plain))
        .withColumn("spans", F.array_sort(F.concat("base", F.transform(more, plain))))
        .drop("_base", "_more")
    )


def joined(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["s"], x["e"])), ",")


def _of_kind(k: int) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == k


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row of df."""
    found = find_spans(df.select(F.col(id_col), F.col(text_col)), text_col)
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(id_col, *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def masked(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with every span of its text replaced by its kind in brackets, as in [EMAIL]; a null text stays null.

    All other columns stay as they are, whatever their names.
    """
    found = find_spans(df.select(whole_rows(df), F.col(text_col).alias("_text")), "_text")
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    text, name = F.col("_text"), F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def put(acc: Column, x: Column) -> Column:
        # Spans of different kinds may overlap; what is masked already is not masked again.
        start = F.greatest(x["s"], acc["at"])
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, start - acc["at"]), F.element_at(name, x["kind"] + 1))
        return F.when(x["e"] <= acc["at"], acc).otherwise(F.struct(F.greatest(x["e"], acc["at"]).alias("at"), piece.alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    new = F.aggregate(ordered, start, put, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    new = F.when(F.size("spans") > 0, new).otherwise(text)
    return found.select(*[new.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in df.columns])
