"""Scalar functions on literature text, as Column expressions. Regexes use (?U) where Unicode classes matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits and signs that stand for ASCII ones.
SUBSCRIPTS, SUPERSCRIPTS = "₀₁₂₃₄₅₆₇₈₉", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻"
# Fixed patterns: numbers, formula-like tokens, mobility words and units, temperatures.
NUMBER = r"([+-]?(?:\d+(?:\.\d*)?|\.\d+))(?:\s*(?:[×x]\s*10\s*(?:\^\s*)?|[eE])\s*([+\-]?\d+))?"
FORMULA = r"(?:\([A-Z][A-Za-z0-9.+\-δxyz%]*\)[0-9.δxyz%+\-]*|[A-Z][a-z]?[0-9.δxyz%+\-]*){2,}"
MENTION = r"(?i)mobility|\bmu\s*[_-]?\s*[hH]?\b"
_WORD = r"(?:hall\s+|carrier\s+|electron\s+)?mobility|\bmu\s*[_-]?\s*[hH]?\b"
_UNIT = r"(?:cm\s*\^?\s*2|cm2|m\s*\^?\s*2|m2)\s*(?:/|\s)*(?:V|v)"
_PLAIN = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:\s*(?:[×x]\s*10\s*(?:\^\s*)?|[eE])\s*[+\-]?\d+)?"
AFTER_WORD = rf"(?i)(?:{_WORD}).{{0,80}}?({_PLAIN}).{{0,35}}?({_UNIT}[^,;.\n]*)"
BEFORE_WORD = rf"(?i)({_PLAIN}).{{0,25}}?({_UNIT}[^,;.\n]*).{{0,80}}?(?:{_WORD})"
TEMPERATURE = r"(?i)(?:at|near|temperature(?:\s+of)?)\s*(room temperature|RT|\d+(?:\.\d+)?\s*(?:K|°C))"


def let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value) with the value computed once. Functions over arrays interpret what stands in them, so that each mention of an expression there is computed anew."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_doi(c: Column) -> Column:
    out = F.regexp_replace(F.trim(c), r"(?i)^https?://(?:dx\.)?doi\.org/", "")
    out = F.trim(F.regexp_replace(out, r"(?i)^doi:\s*", ""))
    return F.lower(F.regexp_replace(out, r"[.,;)]+$", ""))


def safe_filename(c: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(F.substr(out, F.lit(1), F.lit(120)), F.lit("")), F.lit("source"))


def normalize_text(c: Column) -> Column:
    out = F.translate(F.coalesce(c, F.lit("")), SUBSCRIPTS + SUPERSCRIPTS + "−–—", "0123456789" + "0123456789+-" + "---")
    for sign in ("µ", "μ", "\U0001d707"):
        out = F.replace(out, F.lit(sign), F.lit("mu"))
    return F.replace(out, F.lit("·"), F.lit(" "))


def normalized_header(c: Column) -> Column:
    """Normalized, case-folded (letters whose folding isn't their lower case: ß, ς, ſ), white space collapsed."""
    folded = F.translate(F.replace(F.lower(normalize_text(c)), F.lit("ß"), F.lit("ss")), "ςſ", "σs")
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def power_of_ten(power: Column) -> Column:
    """10 to a power given as text, correctly rounded; Spark's pow misses the last digit of 64 of the powers from -323 to 308."""
    return F.concat(F.lit("1e"), power).try_cast("double")


def number_parts(c: Column, pattern: str = NUMBER) -> tuple[Column, Column]:
    """(base, power), as text: the first number of the text and its power of ten; each empty without one."""
    t = F.trim(F.replace(normalize_text(c.cast("string")), F.lit(","), F.lit("")))
    return F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2)


def parse_number(c: Column) -> Column:
    """The first number of the text, with its power of ten; null without one."""
    base, power = number_parts(c)
    parts = F.struct(base.try_cast("double").alias("value"), power.alias("power"))
    out = let(parts, lambda n: F.when(n["power"] == "", n["value"]).otherwise(n["value"] * power_of_ten(n["power"])))
    return let(out, lambda v: F.when(F.abs(v) < float("inf"), v))


def format_number(c: Column) -> Column:
    """Twelve significant digits without trailing zeros; an exponent below 1e-4 and from 1e12; empty for null and non-finite."""
    power = F.floor(F.log10(F.abs(c)))
    power = F.when(F.abs(c) >= F.pow(F.lit(10.0), power + 1), power + 1).otherwise(power).cast("int")
    digits = F.greatest(F.lit(0), 11 - power)
    plain = F.call_function("format_string", F.concat(F.lit("%."), F.least(digits, F.lit(15)).cast("string"), F.lit("f")), c)
    plain = F.when(F.contains(plain, F.lit(".")), F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", "")).otherwise(plain)
    mantissa = F.regexp_replace(F.regexp_replace(F.format_string("%.11f", c / F.pow(F.lit(10.0), power)), "0+$", ""), r"\.$", "")
    sign = F.when(power < 0, F.lit("-")).otherwise(F.lit("+"))
    far = F.concat(mantissa, F.lit("e"), sign, F.lpad(F.abs(power).cast("string"), 2, "0"))
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), "").when(c == 0, "0").when((power < -4) | (power >= 12), far).otherwise(plain)


def elements_of(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit("[A-Z][a-z]?"), F.lit(0)))


def extract_formula(c: Column, required: list[str] | None = None) -> Column:
    """The longest formula-like token that has the required elements, the first among equals; white space is taken out first."""
    t = F.regexp_replace(normalize_text(c), r"(?U)\s+", "")
    for mark in ("_{", "^{", "}"):
        t = F.replace(t, F.lit(mark), F.lit(""))
    found = F.regexp_extract_all(t, F.lit(FORMULA), F.lit(0))
    if required:
        need = F.array(*[F.lit(x) for x in required])
        found = F.filter(found, lambda x: F.size(F.array_except(need, elements_of(x))) == 0)
    found = F.transform(found, lambda x: F.regexp_replace(x, r"^[.,;:]+|[.,;:]+$", ""))
    return F.aggregate(found, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))


def mobility_multiplier(c: Column) -> Column:
    """STRUCT(scale, unit, note) of a header or unit."""
    t = F.regexp_replace(normalized_header(c), r"(?U)\s+", "")
    power = F.regexp_extract(t, r"10(?:\^)?([+\-]?\d+)", 1)
    scale = F.when(power == "", F.lit(1.0)).otherwise(power_of_ten(power))
    told = lambda s, u, n: F.struct(s.alias("scale"), F.lit(u).alias("unit"), F.lit(n).alias("note"))
    return (
        F.when(t.rlike(r"cm\^?2"), told(scale, "cm2 V-1 s-1", ""))
        .when(t.rlike(r"m\^?2"), told(scale * 1e4, "m2 V-1 s-1", ""))
        .otherwise(told(F.lit(1.0), "", "mobility unit not recognized; value was not rescaled"))
    )


def parse_temperature(value: Column, header: Column | None = None) -> Column:
    """STRUCT(kelvin, note)."""
    both = normalized_header(F.concat_ws(" ", header if header is not None else F.lit(""), F.coalesce(value, F.lit(""))))
    number = parse_number(value)
    told = lambda k, n: F.struct(k.cast("double").alias("kelvin"), F.lit(n).alias("note"))
    return (
        F.when(F.contains(both, F.lit("room temperature")) | both.isin("rt", "r.t."), told(F.lit(300.0), "room temperature normalized to 300 K"))
        .when(number.isNull(), told(F.lit(None), "temperature missing"))
        .when(both.rlike("°c|deg c|celsius"), told(number + 273.15, "temperature converted from Celsius to kelvin"))
        .otherwise(told(number, ""))
    )


def infer_code(context: Column, mapping: dict) -> Column:
    """STRUCT(code, note): the one code whose phrases the context has."""
    told = lambda c, n: F.struct(c.alias("code"), F.lit(n).alias("note"))
    if not mapping.get("enabled"):
        return told(F.lit(""), "categorical mapping disabled pending scientific confirmation")
    text = normalized_header(context)
    hits = [F.when(F.contains(text, normalized_header(F.lit(p))), F.lit(str(code))) for p, code in mapping.get("values", {}).items()]
    codes = F.array_distinct(F.array_compact(F.array(*hits)))
    default = str(mapping.get("default", ""))
    return F.when(F.size(codes) == 1, told(F.element_at(codes, 1), "")).when(F.size(codes) > 1, told(F.lit(""), "conflicting categorical descriptions")).otherwise(told(F.lit(default), "categorical value defaulted" if default else "categorical value missing"))


def candidate_id(*fields: Column) -> Column:
    return F.substr(F.sha2(F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256), F.lit(1), F.lit(16))


def stable_id(given: Column, doi: Column, value: Column) -> Column:
    key = F.coalesce(F.nullif(doi, F.lit("")), value)
    return F.coalesce(F.nullif(given, F.lit("")), F.concat(F.lit("paper-"), F.substr(F.sha1(key.cast("binary")), F.lit(1), F.lit(12))))


def evidence(cells: Column) -> Column:
    return F.substr(F.array_join(cells, " | "), F.lit(1), F.lit(1200))


def url_problem(url: Column) -> Column:
    """Why a URL isn't safe to fetch, as far as its text tells; null if nothing speaks against it."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    local = host.isin("localhost", "") | host.endswith(".local") | host.endswith(".localhost")
    private = host.rlike(r"^(?:0|10|127)\.|^169\.254\.|^192\.168\.|^172\.(?:1[6-9]|2\d|3[01])\.|^100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^192\.0\.[02]\.|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\.|^(?:22[4-9]|2[3-5]\d)\.|^\[(?:::1?|f[cd].*|fe80.*)\]$")
    return (
        F.when(~F.lower(F.coalesce(url, F.lit(""))).rlike("^https?://"), "unsupported scheme")
        .when(F.try_parse_url(url, F.lit("USERINFO")).isNotNull(), "credentials in URL")
        .when(local | private, "non-public destination")
    )


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"(?U)\s+", " "))


def publisher_url(url: Column, doi: Column) -> Column:
    """The file that a publisher's landing page of known form stands for; null for other URLs."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    parts = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda x: x != "")
    tail = F.regexp_replace(normalize_doi(F.coalesce(doi, F.lit(""))), r"^[^/]*/", "")
    part = lambda k: F.get(parts, F.size(parts) + k)
    named = F.regexp_extract(tail, r"(?i)^([a-z-]+?)\d{4,}$", 1)
    slug = F.when(named == "", F.lower(F.get(parts, F.lit(0)))).otherwise(F.lower(named))
    slug = F.when(slug == "app", "applsci").otherwise(slug)  # fixed value
    article = F.when(F.length(part(-2)) < 5, F.lpad(part(-2), 5, "0")).otherwise(part(-2))
    file = F.concat_ws("-", slug, part(-4), article)
    known = host.isin("www.mdpi.com", "mdpi.com") & (F.size(parts) >= 5) & F.lower(part(-1)).isin("pdf", "full") & article.rlike(r"^\d+$") & part(-4).rlike(r"^\d+$")
    return F.when(known, F.concat(F.lit("https://mdpi-res.com/d_attachment/"), slug, F.lit("/"), file, F.lit("/article_deploy/"), file, F.lit(".pdf")))


def resolved(link: Column, base: Column) -> Column:
    """A link of a page at base as a whole URL: links with a scheme, `//host`, `/path` and relative paths without dots."""
    origin, scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(origin, link))
        .otherwise(F.concat(folder, F.lit("/"), link))
    )


def pdf_link(html: Column) -> Column:
    """The PDF that a page names: a citation tag, a link of that type, or an anchor."""
    # Fixed patterns.
    rules = (r"(?is)<meta[^>]+name=[\"']citation_pdf_url[\"'][^>]+content=[\"']([^\"']+)", r"(?is)<link[^>]+type=[\"']application/pdf[\"'][^>]+href=[\"']([^\"']+)", r"(?is)<a[^>]+href=[\"']([^\"']+\.pdf(?:\?[^\"']*)?)[\"']")
    return F.coalesce(*[F.nullif(F.regexp_extract(html, r, 1), F.lit("")) for r in rules])


def mention_count(c: Column) -> Column:
    """How often a text, as it stands, mentions a mobility."""
    return F.coalesce(F.regexp_count(c, F.lit(MENTION)), F.lit(0)).cast("long")


def mobility_from_text(c: Column) -> Column:
    """STRUCT(value, raw, unit): the number after, else before, a mobility word, in cm2 V-1 s-1; null without one."""
    t = normalize_text(c)

    def by(rule: str) -> Column:
        raw, unit = F.regexp_extract(t, rule, 1), F.regexp_extract(t, rule, 2)
        m = mobility_multiplier(unit)
        return F.when(raw != "", F.struct((parse_number(raw) * m["scale"]).alias("value"), raw.alias("raw"), F.when(m["unit"] != "", unit).otherwise(F.lit("")).alias("unit")))

    return F.coalesce(by(AFTER_WORD), by(BEFORE_WORD))
