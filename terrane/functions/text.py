"""Names, credits and printed figures as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose tags part words, and the character references that a credit may hold (fixed values; & comes last).
BREAKS = "br|p|div|li|ul|ol|tr|td"
REFERENCES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&ndash;", "–"), ("&mdash;", "—"), ("&amp;", "&")]


def some(c: Column) -> Column:
    """The empty text counts as none."""
    return F.nullif(c, F.lit(""))


def preferred_name(tags: Column, language: str, field: str = "name") -> Column:
    """The name in the language, else the plain one, else null."""
    return F.coalesce(some(F.try_element_at(tags, F.lit(f"{field}:{language}"))), some(F.try_element_at(tags, F.lit(field))))


def is_shouted(s: Column) -> Column:
    """Has letters and none in lower case."""
    return s.rlike(r"\p{L}") & ~s.rlike(r"\p{Ll}")


def first_name(names: list[Column]) -> Column:
    """The first non-blank name that is not shouted, else the first shouted one."""
    kept = F.filter(F.array(*(some(F.trim(n)) for n in names)), lambda n: n.isNotNull())
    return F.coalesce(F.get(F.filter(kept, lambda n: ~is_shouted(n)), 0), F.get(kept, 0))


def admin_level(v: Column) -> Column:
    """A whole number from 1 to 12 without spaces, else null."""
    n = F.when(v.rlike(r"^[+-]?[0-9]{1,9}$"), v.cast("int"))
    return F.when(n.between(1, 12), n)


def collapse_space(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def strip_tags(s: Column) -> Column:
    """Tags out; those that part words leave a space; what follows an unclosed < stays."""
    return F.regexp_replace(F.regexp_replace(s, rf"(?i)</?(?:{BREAKS})(?:[\s/][^>]*)?>", " "), r"<[^>]*>", "")


def plain_credit(s: Column) -> Column:
    """A credit as plain text: tags out, references read once, spaces collapsed; the original if nothing is left."""
    out = strip_tags(s)
    for ref, char in REFERENCES:
        out = F.replace(out, F.lit(ref), F.lit(char))
    return F.coalesce(some(collapse_space(out)), collapse_space(s))


def terminal_safe(s: Column) -> Column:
    return F.regexp_replace(F.translate(s, "\t", " "), "[\\p{Cc}  ]", "")


def redact(url: Column) -> Column:
    """Credentials and query of a URL replaced, the fragment dropped."""
    out = F.regexp_replace(url, r"#.*$", "")
    out = F.regexp_replace(out, r"^([a-zA-Z][a-zA-Z0-9+.-]*://)[^/?#@]*@", "$1redacted@")
    return F.regexp_replace(out, r"\?.*$", "?redacted")


def human_bytes(n: Column) -> Column:
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" bytes")))
    units = ["KiB", "MiB", "GiB", "TiB", "PiB"]
    for k, u in enumerate(units, 1):
        text = F.concat(F.format_string("%.1f", F.round(n / F.lit(float(1024**k)), 1)), F.lit(f" {u}"))
        out = out.when(n < 1024 ** (k + 1), text) if k < len(units) else out.otherwise(text)
    return out


def human_distance(m: Column) -> Column:
    """Whole metres under a kilometre, one decimal under ten (none if it is 0), else whole kilometres."""
    tenth = F.round(m / 1000.0, 1)
    mid = F.when(tenth == F.floor(tenth), F.format_string("%d km", tenth.cast("long"))).otherwise(F.format_string("%.1f km", tenth))
    return F.when(m < 1000, F.format_string("%d m", F.round(m).cast("long"))).when(m < 10000, mid).otherwise(F.format_string("%d km", F.round(m / 1000.0).cast("long")))


def format_coordinate(v: Column) -> Column:
    """Seven decimals without trailing zeros; never -0."""
    out = F.regexp_replace(F.format_string("%.7f", v), r"\.?0+$", "")
    return F.when(out.isin("-0", ""), "0").otherwise(out)


def source_id(source: Column, build: Column) -> Column:
    """16 hex digits that name a source and its build."""
    return F.substring(F.sha2(F.concat(source, F.lit("\0"), build), 256), 1, 16)


def match_name(aliases: Column, query: Column) -> Column:
    """'exact' if any alias equals the query but for case, 'near' if one starts with it and a space, else null."""
    q = F.lower(query)
    exact = F.exists(aliases, lambda a: F.lower(a) == q)
    near = F.exists(aliases, lambda a: F.startswith(F.lower(a), F.concat(q, F.lit(" "))))
    return F.when(exact, "exact").when(near, "near")
