"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Seeds are the matches of the base patterns (e-mail and IP addresses, payment cards by Luhn, phone numbers), access keys of known
form, and, as weak seeds, long runs of hexadecimal digits. A lexical pattern is what stands before a value: the token before
it, the two tokens before it, or the `name=` or `name:` with or without spaces and quotes. Patterns and values are a graph whose edges are counted from the corpus: a pattern
is as sure as the share of all its occurrences that a sure value follows, a value as sure as its own
form (WEAK for a weak seed, 0 for any other identifier) or the patterns before it make it together. ROUNDS rounds of this start from the seeds; patterns that
are sure enough, and were seen with enough different seeds, discover other
identifiers (tokens of LEAST characters or more with a digit), which are added as spans of kind `id`, as are access keys.
Frequent words come before anything, so they are never sure patterns, and texts without telling
contexts keep their base spans and access keys alone.

The contract's expressions are written so that they take linear time: they start only where a run
starts and never give back what they took. Positions are code points, the end exclusive. A context
token that isn't whole within LEFT characters before the value is no pattern, and counts as none anywhere.

Null counts as empty and has no spans; rows are judged each for itself, and equal rows alike. An empty table gives an empty one. Extra columns stay, whatever their
names; those that annotated() adds replace any of the same name, and redacted() adds none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

KINDS = ("email", "ip", "card", "phone")
#: The same matches as the plain expressions give leftmost without overlaps; of card chains only those of 12 to 19 digits.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
IDENTIFIER = r"(?<![A-Za-z0-9_.@+/-])[A-Za-z_.@+/-]*+[0-9][A-Za-z0-9_.@+/-]*+"
#: Published forms of access keys, which are sure by themselves.
ACCESS_KEY = r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abps]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35})$"
#: Hexadecimal digits of which some are letters: what keys, digests and generated passwords look like.
HEXADECIMAL = r"^(?=[0-9a-f]*[a-f])[0-9a-f]{16,}$"
ROUNDS, SURE, SUPPORT, LEAST, WEAK, LEFT = 3, 0.6, 5, 6, 0.7, 120
#: Entries of one step where an array is built up: building costs the square of it.
PART = 128


_SPAN = "array<struct<start:int,end:int,value:string>>"


def located(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of a pattern's matches: what stands between them gives the places.

    Places are added up over parts of PART matches and then within each, so time doesn't grow with the square of the matches.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    every = F.filter(F.transform(F.arrays_zip(found.alias("value"), between.alias("gap")), lambda x: F.struct(x["value"].alias("value"), F.length(x["gap"]).alias("gap"))), lambda x: x["value"].isNotNull())
    size = lambda x: x["gap"] + F.length(x["value"])
    parts = lambda pairs: F.transform(F.sequence(F.lit(0), F.size(pairs) - 1, F.lit(PART)), lambda k: F.slice(pairs, k + 1, F.lit(PART)))
    based = lambda pairs: F.aggregate(
        parts(pairs),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,own:array<struct<value:string,gap:int>>>>").alias("out")),
        lambda s, x: F.struct(F.aggregate(x, s["at"], lambda n, y: n + size(y)).alias("at"), F.concat(s["out"], F.array(F.struct(s["at"].alias("at"), x.alias("own")))).alias("out")),
        lambda s: s["out"],
    )
    step = lambda s, x: F.struct(
        (s["at"] + size(x)).alias("at"),
        F.concat(s["out"], F.array(F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + size(x)).alias("end"), x["value"].alias("value")))).alias("out"),
    )
    placed = lambda pairs: F.flatten(F.transform(based(pairs), lambda p: F.aggregate(p["own"], F.struct(p["at"].alias("at"), F.array().cast(_SPAN).alias("out")), step, lambda s: s["out"])))
    return _let(every, lambda pairs: F.when(F.size(pairs) > 0, placed(pairs)).otherwise(F.array().cast(_SPAN)))


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value) with the value computed once: within a lambda function an expression would be computed at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits pass Luhn's check; every second from the right counts double, less 9 over 9."""
    d = F.reverse(_digits(value))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)),
        F.lit(0),
        lambda s, i: s + F.when(i % 2 == 1, F.substr(d, i, F.lit(1)).cast("int")).otherwise((F.substr(d, i, F.lit(1)).cast("int") * 2) % 10 + F.floor(F.substr(d, i, F.lit(1)).cast("int") / 5).cast("int")),
    )
    return total % 10 == 0


_VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"),
    "card": lambda v: _luhn(v),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}
#: A character without which a pattern can't match: most texts are passed over at that.
_NEEDS = {"email": lambda t: F.contains(t, F.lit("@")), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9][ -]?[0-9][ -]?[0-9]"), "phone": lambda t: t.rlike(r"\+[0-9]")}


def base_spans(text: Column) -> dict[str, Column]:
    """By kind, the array of (start, end, value) of valid matches."""
    none = F.array().cast(_SPAN)

    def valid(kind: str) -> Column:
        return F.filter(located(text, PATTERNS[kind]), lambda x: _VALID[kind](x["value"]))

    return {kind: F.when(_NEEDS[kind](text), valid(kind)).otherwise(none) for kind in KINDS}


def _tokens(text: Column) -> Column:
    """Tokens as contexts are written: lower case, digits as 0, no quotes, `name=` and `name:` one token whatever spaces stand around the sign."""
    plain = F.translate(F.translate(F.lower(text), "123456789", "000000000"), "\"'`<([{", "")
    return F.filter(F.split(F.regexp_replace(plain, r"\s*([=:])", "$1"), r"\s+|(?<=[=:])"), lambda x: x != "")


def _contexts(text: Column, start: Column) -> Column:
    """Array of the patterns before a value: its last token, and the last two. A token that LEFT characters don't hold whole is none."""
    left = F.substr(text, F.greatest(F.lit(1), start - LEFT + 1), F.least(start, F.lit(LEFT)))

    def told(tokens: Column) -> Column:
        n, first = F.size(tokens), F.when(start > LEFT, F.lit(1)).otherwise(F.lit(0))
        one, two = F.when(n > first, F.get(tokens, n - 1)), F.when(n - 1 > first, F.get(tokens, n - 2))
        return F.filter(F.array(one, F.when(two.isNotNull(), F.concat_ws(" ", two, one))), lambda x: x.isNotNull())

    return _let(_tokens(left), told)


def _ordered(spans: dict[str, Column]) -> Column:
    """All spans as an array of (start, rank, kind, end), in order."""

    def told(i: int, kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    return F.array_sort(F.concat(*[told(i, kind, a) for i, (kind, a) in enumerate(spans.items())]))


def _outside(ids: Column, base: Column) -> Column:
    """Identifiers that no span of base, in order of start, overlaps; parts of base that lie apart are passed over whole."""
    parts = F.transform(F.sequence(F.lit(0), F.size(base) - 1, F.lit(PART)), lambda k: F.slice(base, k + 1, F.lit(PART)))
    told = F.transform(parts, lambda p: F.struct(F.element_at(p, 1)["start"].alias("lo"), F.array_max(F.transform(p, lambda x: x["end"])).alias("hi"), p.alias("own")))
    over = lambda x, a, b: (a < x["end"]) & (x["start"] < b)
    free = _let(told, lambda t: F.filter(ids, lambda x: ~F.exists(t, lambda p: over(x, p["lo"], p["hi"]) & F.exists(p["own"], lambda b: over(x, b["start"], b["end"])))))
    return F.when(F.size(base) > 0, free).otherwise(ids)


def extracted(documents: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """(d, row, t, base, seen), written: d is the documents' columns, row a number, t the text if kept, base the
    array of (start, rank, kind, end), seen that of (start, end, value, contexts, seed, prior) of seeds and other identifiers."""
    d = F.struct(*[F.col(f"`{c}`") for c in documents.columns if keep_text or c != text], F.lit(0).alias("_"))
    rows = documents.select(d.alias("d"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumns(base_spans(F.col("t")))
    ids = F.when(F.col("t").rlike("[0-9]"), F.filter(located(F.col("t"), IDENTIFIER), lambda x: F.length(x["value"]) >= LEAST)).otherwise(F.array().cast(_SPAN))
    rows = rows.withColumn("ids", ids).withColumn("base", _ordered({k: F.col(k) for k in KINDS}))

    def seen(spans: Column, prior) -> Column:  # noqa: ANN001
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), _contexts(F.col("t"), x["start"]).alias("contexts"), prior(x["value"]).alias("prior")))

    own = lambda v: F.when(v.rlike(ACCESS_KEY), 1.0).when(v.rlike(HEXADECIMAL), WEAK).otherwise(0.0)
    bases = [seen(F.col(k), lambda v: F.lit(1.0)) for k in KINDS]
    rows = rows.withColumn("known", F.concat(*bases)).withColumn("free", seen(_outside(F.col("ids"), F.col("base")), own))
    return written(rows.select("d", F.monotonically_increasing_id().alias("row"), *(["t"] if keep_text else []), "base", "known", "free"), "pii")


def _occurrences(documents: DataFrame, text: str, contexts: DataFrame) -> DataFrame:
    """How often each of the contexts stands in the corpus, written as contexts are. They are few: all others go before anything is counted or shuffled."""
    tokens = _tokens(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    rows = documents.select(tokens.alias("w"))
    each = F.transform("w", lambda x, i: F.struct(x.alias("one"), F.when(i > 0, F.concat_ws(" ", F.get("w", i - 1), x)).alias("two")))
    both = rows.select(F.explode(each).alias("x")).select(F.explode(F.array("x.one", "x.two")).alias("context")).filter("context is not null")
    few = contexts.select("context")
    if contexts.count() <= 10_000:
        few = F.broadcast(few)
    return both.join(few, "context", "left_semi").groupBy("context").agg(F.count("*").alias("total"))


def discovered(documents: DataFrame, found: DataFrame, text: str = "text", rounds: int = ROUNDS, sure: float = SURE, support: int = SUPPORT) -> DataFrame:
    """(row, start, end) of identifiers that are sure by their form or that sure patterns lead to. found: extracted(documents)."""
    free = found.select("row", F.explode("free").alias("s")).select("row", "s.*")
    certain = free.filter(F.col("prior") >= 1).select("row", "start", "end")
    either = found.select("row", F.explode(F.concat("known", "free")).alias("s")).select("row", "s.value", "s.prior", F.explode("s.contexts").alias("context"))
    counts = either.groupBy("context", "value").agg(F.count("*").alias("n"), F.max("prior").alias("prior"))
    # A pattern needs support different seeds: few contexts have that, and only they are looked up in the corpus.
    backed = written(counts.groupBy("context").agg(F.count_if(F.col("prior") > 0).alias("seeds"), F.sum("n").alias("followed"), F.sum(F.when(F.col("prior") > 0, F.col("n"))).alias("led")).filter(F.col("seeds") >= support), "backed")
    if not backed.limit(1).count():
        return certain
    totals = _occurrences(documents, text, backed)
    # A pattern whose seeds and their like are a small share of its occurrences can't become sure.
    graph = backed.join(totals, "context", "left").withColumn("total", F.greatest(F.coalesce("total", F.lit(0)), "followed"))
    graph = written(counts.join(graph.filter(F.col("followed") >= sure * (F.col("total") + 1)).select("context", "total"), "context"), "graph")
    score = graph.groupBy("value").agg(F.max("prior").alias("score"))
    for _ in range(rounds):
        pattern = graph.join(score, "value").groupBy("context").agg((F.sum(F.col("n") * F.col("score")) / (F.max("total") + 1)).alias("confidence"))
        told = graph.join(pattern.filter(F.col("confidence") >= sure), "context").groupBy("value").agg((1 - F.exp(F.sum(F.ln(1 - F.least("confidence", F.lit(0.999)))))).alias("told"))
        score = written(graph.groupBy("value").agg(F.max("prior").alias("own")).join(told, "value", "left").select("value", F.greatest("own", F.coalesce("told", F.lit(0.0))).alias("score"), F.col("told").isNotNull().alias("led")), "score")
    good = score.filter(F.col("led") & (F.col("score") >= sure)).select("value")
    return certain.unionByName(free.join(good, "value", "left_semi").select("row", "start", "end")).distinct()


def _with_spans(documents: DataFrame, text: str, keep_text: bool) -> DataFrame:
    """extracted() with span_list: base spans and those that the method adds, in order."""
    found = extracted(documents, text, keep_text)
    more = discovered(documents, found, text).groupBy("row").agg(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("rank"), F.lit("id").alias("kind"), "end")).alias("more"))
    return found.join(more, "row", "left").withColumn("span_list", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>"))))))


def _spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def annotated(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents without the text, with n_email, n_ip, n_card, n_phone, base_sha256, spans and span_list."""
    number = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    own = {f"n_{kind}": number(kind) for kind in KINDS} | {"base_sha256": F.sha2(_spelled(F.col("base")).cast("binary"), 256), "spans": _spelled(F.col("span_list")), "span_list": F.col("span_list")}
    keep = [c for c in documents.columns if c != text and c.lower() not in own]
    out = _with_spans(documents, text, keep_text=False)
    return out.select(*[F.col(f"d.`{c}`").alias(c) for c in keep], *[c.alias(name) for name, c in own.items()])


def redacted(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with each span's characters replaced by its kind in brackets; the first of overlapping spans names them. n_chars follows the text."""
    rows = _with_spans(documents, text, keep_text=True)
    rows = rows.withColumn("span_list", _apart(F.col("span_list")))
    # The pieces between spans are joined at the end: adding to one text would copy it at each span.
    end = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("span_list", i - 1)["end"])
    piece = lambda x, i: F.concat(
        F.substr(F.col("t"), end(i) + 1, F.greatest(F.lit(0), x["start"] - end(i))),
        F.when((i == 0) | (x["start"] >= end(i)), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(F.lit("")),
    )
    last = F.substr(F.col("t"), F.element_at("span_list", -1)["end"] + 1)
    changed = F.when(F.size("span_list") > 0, F.concat(F.array_join(F.transform("span_list", piece), ""), last)).otherwise(F.col(f"d.`{text}`").cast("string"))
    out = rows.withColumn("t", changed)
    columns = [F.col("t").alias(c) if c == text else F.col(f"d.`{c}`").alias(c) for c in documents.columns]
    if "n_chars" in documents.columns and text != "n_chars":
        columns[documents.columns.index("n_chars")] = F.length("t").cast(documents.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*columns)


def _apart(spans: Column) -> Column:
    """Spans with ends that never fall: one that overlaps those before it starts where they end; one within them goes."""
    reach = F.transform(spans, lambda x, i: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["kind"].alias("kind"), x["end"].alias("end")))
    before = lambda i: F.coalesce(F.array_max(F.transform(F.slice(spans, F.greatest(F.lit(1), i - PART + 1), F.least(i, F.lit(PART))), lambda y: y["end"])), F.lit(0))
    return F.filter(reach, lambda x, i: x["end"] > before(i))
