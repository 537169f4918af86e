"""Scalar text functions, Column to Column.

Three normalisers differ on purpose: quotes keep punctuation and fold typography,
claim wording keeps ASCII letters and digits only, titles are Unicode-aware.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that do not tell claims apart.
STOP_WORDS = "a an and are as at be by for from has have in is it its of on or that the to was were with".split()
# Name suffixes that are no family names.
NAME_SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "phd", "md", "esq"]
# Typographic quotes and dashes and what they count as.
TYPOGRAPHY = ("‘’“”–—", "''\"\"--")


def _accents() -> tuple[str, str]:
    """Small Latin letters that are an ASCII letter with one accent, and those letters."""
    apart = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in (*range(0xDF, 0x250), *range(0x1E00, 0x1F00))}
    one = {c: d[0] for c, d in apart.items() if len(d) == 2 and "a" <= d[0] <= "z"}
    return "".join(one), "".join(one.values())


ACCENTS = _accents()
VALUE_TOLERANCE, OVERLAP_THRESHOLD = 0.001, 0.6
TABLE_CHARS, TABLE_MARK = 4000, "\n[table truncated]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_quote(c) -> Column:
    """Typography folded, lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(F.translate(_col(c), *TYPOGRAPHY)), r"(?U)[\s\x1c-\x1f]+", " "))


def normalize_ascii(c) -> Column:
    return F.trim(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", " "))


def unescape(c) -> Column:
    """The XML entities; &amp; last, so that nothing is unescaped twice."""
    out = _col(c)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def normalize_title(c) -> Column:
    """Entities decoded, markup dropped, anything but letters and digits (of any script) one space."""
    bare = F.regexp_replace(F.lower(unescape(c)), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(bare, r"(?U)[\W_]+", " "))


def tokens(c) -> Column:
    """The distinct words of normalize_ascii that are no stop words."""
    words = F.filter(F.split(normalize_ascii(c), " "), lambda w: w != "")
    return F.array_except(words, F.array(*[F.lit(w) for w in STOP_WORDS]))


def overlap(a, b) -> Column:
    """Shared tokens by the smaller set's size; 0 where either is empty."""
    a, b = _col(a), _col(b)
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def values_match(golden, row) -> Column:
    """Within 0.1 % of the golden value; false if either is null."""
    g, r = _col(golden), _col(row)
    return F.coalesce(F.abs(g - r) <= F.abs(g) * VALUE_TOLERANCE, F.lit(False))


def year_of(c) -> Column:
    """The first 19xx or 20xx that stands alone, or null."""
    return F.nullif(F.regexp_extract(_col(c), r"(?U)\b((?:19|20)\d{2})\b", 1), F.lit("")).cast("int")


def year_flag(year, text) -> Column:
    """0 if the year stands in the text, 1 if not, null without a year."""
    y = _col(year)
    return F.when(y.isNull(), None).otherwise(F.when(F.regexp_like(_col(text), F.concat(F.lit(r"(?U)\b"), y.cast("string"), F.lit(r"\b"))), 0).otherwise(1))


def clean_doi(c) -> Column:
    bare = F.regexp_replace(F.trim(_col(c)), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:)\s*", "")
    return F.when(bare.rlike(r"^10\.\d{4,9}/\S+$"), bare)


def clean_isbn(c) -> Column:
    """Separators and the ISBN prefix dropped, the check digit verified; null if it fails."""
    bare = F.regexp_replace(F.upper(F.regexp_replace(_col(c), r"[\s\-–—]", "")), r"^ISBN(?:10|13)?:?", "")
    digit = lambda ch: F.when(ch == "X", 10).otherwise(F.try_to_number(ch, F.lit("9")).cast("int"))
    weigh = lambda n, w: F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda acc, i: acc + digit(F.substring(bare, i, F.lit(1))) * w(i))
    ten = bare.rlike(r"^\d{9}[\dX]$")
    thirteen = bare.rlike(r"^\d{13}$")
    return F.when(ten, F.when(weigh(10, lambda i: 11 - i) % 11 == 0, bare)).when(thirteen, F.when(weigh(13, lambda i: F.when(i % 2 == 1, 1).otherwise(3)) % 10 == 0, bare))


def isbn_core(c) -> Column:
    """The nine digits that an ISBN-10 and its 978- form share; null for other forms."""
    x = _col(c)
    return F.when(F.length(x) == 10, F.substring(x, 1, 9)).when((F.length(x) == 13) & x.startswith("978"), F.substring(x, 4, 9))


def same_isbn(a, b) -> Column:
    return (_col(a) == _col(b)) | F.coalesce(isbn_core(a) == isbn_core(b), F.lit(False))


def phrase(c) -> Column:
    """Words in order, runs of single characters fused ("U.N." is "un"), joined by spaces."""
    words = F.array_join(F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit("[a-z0-9]+"), 0), " ")
    return F.regexp_replace(words, r"(?<=(?:^| )[a-z0-9]) (?=[a-z0-9](?: |$))", "")


def contains_phrase(hay, needle) -> Column:
    """needle's words stand side by side in hay; both as phrase() gives them, needle not empty."""
    pad = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    return (needle != "") & F.contains(pad(hay), pad(needle))


def publisher_authority(c, tier1: list[str], tier2: list[str]) -> Column:
    hay = phrase(c)
    hit = lambda names: F.exists(F.array(*[phrase(F.lit(n)) for n in names]) if names else F.array().cast("array<string>"), lambda n: contains_phrase(hay, n))
    p = _col(c)
    return F.when(p.isNull() | (p == ""), 0.0).when(hit(tier1), 30.0).when(hit(tier2), 22.5).otherwise(15.0)


def publishers_agree(a, b) -> Column:
    x, y = phrase(a), phrase(b)
    return contains_phrase(x, y) & (x != "") | contains_phrase(y, x) & (y != "")


def family_names(authors) -> Column:
    """Of each author the last word before a comma that is no suffix, lower case; distinct."""

    def one(author):
        words = F.reverse(F.regexp_extract_all(F.lower(F.split(author, ",")[0]), F.lit("[a-z][a-z'-]+"), 0))
        # from behind, the first word that is no suffix
        return F.try_element_at(F.filter(words, lambda w: ~w.isin(NAME_SUFFIXES)), F.lit(1))

    return F.array_distinct(F.filter(F.transform(_col(authors), one), lambda n: n.isNotNull()))


def search_phrases(c) -> Column:
    """Whitespace-separated tokens of a query that hold more than quotation marks, each as its folded words."""
    raw = F.filter(F.split(_col(c), r"(?U)\s+"), lambda t: F.replace(t, F.lit('"'), F.lit("")) != "")
    return F.filter(F.transform(raw, lambda t: fold_words(t)), lambda w: F.size(w) > 0)


def fold_words(c) -> Column:
    """Runs of letters and digits, case and accents folded."""
    return F.regexp_extract_all(F.translate(F.lower(_col(c)), *ACCENTS), F.lit(r"[\p{L}\p{N}]+"), 0)


def n_words(c) -> Column:
    """How many folded words there are."""
    return F.regexp_count(F.translate(F.lower(_col(c)), *ACCENTS), F.lit(r"[\p{L}\p{N}]+"))


def table_text(caption, markdown) -> Column:
    """Caption, blank line, Markdown; cut to 4000 characters and marked; null if empty."""
    full = F.trim(F.concat_ws("\n\n", F.nullif(F.trim(_col(caption)), F.lit("")), _col(markdown)))
    cut = F.when(F.length(full) > TABLE_CHARS, F.concat(F.substring(full, 1, TABLE_CHARS), F.lit(TABLE_MARK))).otherwise(full)
    return F.nullif(cut, F.lit(""))


def figure_text(caption, page, description) -> Column:
    label = F.coalesce(F.nullif(F.trim(_col(caption)), F.lit("")), F.concat(F.lit("Figure on page "), _col(page).cast("string")), F.lit("Figure"))
    return F.concat_ws("\n\n", label, F.nullif(F.trim(_col(description)), F.lit("")))


def evidence_query(text, year) -> Column:
    """The claim's text, and its year if the text does not hold it."""
    y = _col(year).cast("string")
    return F.when(y.isNotNull() & ~F.contains(_col(text), y), F.concat_ws(" ", _col(text), y)).otherwise(_col(text))


def fingerprint(*parts) -> Column:
    return F.sha2(F.concat_ws("\u001e", *[_col(p) for p in parts]), 256)


def verdict_stamp(prompt_hash, k: int) -> Column:
    return F.concat(_col(prompt_hash), F.lit(f":k={k}"))


def fraction(score) -> Column:
    """A score out of 100 as a fraction with four places; null stays."""
    return F.bround(_col(score) / 100, 4)


def percent(v) -> Column:
    return F.floor(_col(v) * 100 + 0.5)


def percent_label(v) -> Column:
    return F.coalesce(F.concat(percent(v).cast("string"), F.lit("%")), F.lit("—"))


def delta_label(a, b) -> Column:
    d = percent(b) - percent(a)
    return F.coalesce(F.concat(F.when(d > 0, "+").otherwise(""), d.cast("string")), F.lit("—"))


def ring(score) -> Column:
    s = _col(score)
    return F.when(s.isNull(), "none").when(s >= 70, "good").when(s >= 40, "fair").otherwise("poor")


def elapsed_label(started, now) -> Column:
    m = F.greatest(F.lit(0), F.floor((F.unix_timestamp(_col(now).cast("timestamp")) - F.unix_timestamp(_col(started).cast("timestamp"))) / 60 + 0.5)).cast("long")
    return F.when(m < 1, "just started").when(m < 60, F.concat(F.lit("running for "), m.cast("string"), F.lit(" min"))).otherwise(
        F.concat(F.lit("running for "), F.floor(m / 60).cast("string"), F.lit(" h "), (m % 60).cast("string"), F.lit(" min"))
    )


def error_hint(error) -> Column:
    """What a failed run's error calls for; null if unknown."""
    e = _col(error)
    return F.when(e.rlike("(?i)APIConnectionError|Connection error"), "connection").when(e.rlike("(?i)TimeoutError.*Batch|still 'in_progress'"), "queued").when(e.rlike("(?i)credit balance|billing"), "billing")


def parse_weights(spec: str, known: tuple[str, ...] = ("coverage", "consistency", "methodology", "context", "recency")) -> dict[str, float]:
    """'name:weight,...' into weights that sum to 1; anything else raises ValueError."""
    import math

    out: dict[str, float] = {}
    for part in spec.split(","):
        name, _, number = (x.strip() for x in part.partition(":"))
        if name not in known or name in out:
            raise ValueError(f"unknown or repeated component in {part!r}")
        try:
            out[name] = float(number)
        except ValueError:
            raise ValueError(f"no number in {part!r}") from None
        if not 0 <= out[name] < math.inf:
            raise ValueError(f"weight out of range in {part!r}")
    if abs(sum(out.values()) - 1) > 0.001:
        raise ValueError(f"weights of {spec!r} do not sum to 1")
    return out
