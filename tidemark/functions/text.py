"""Text: names, markup, formats and form checks, all as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that a font's damaged ligatures come out as, and what they stand for.
LIGATURES = {
    "ﬀ": "ff",
    "ﬁ": "fi",
    "ﬂ": "fl",
    "ﬃ": "ffi",
    "ﬄ": "ffl",
    "ﬅ": "st",
    "ﬆ": "st",
    "+": "ti",
    "#": "ti",
}
ZERO_WIDTH, NBSP = "\u200b", "\u00a0"
#: White space as Unicode has it.
SPACE = r"(?U)\s+"


def norm(s: Column) -> Column:
    """Lower case, a-z only."""
    return F.regexp_replace(F.lower(s), "[^a-z]", "")


def replace_all(s: Column, pairs: Mapping[str, str]) -> Column:
    """Literal replacements, one after the other."""
    for old, new in pairs.items():
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def expand_ligatures(s: Column) -> Column:
    return replace_all(s, LIGATURES)


def squeeze(s: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(s, SPACE, " "))


def text_of(html: Column) -> Column:
    """An element's visible text: no tags, no zero-width spaces, white space squeezed."""
    return squeeze(F.replace(F.regexp_replace(html, "<[^>]+>", ""), F.lit(ZERO_WIDTH), F.lit("")))


def decode_numeric(s: Column) -> Column:
    """``&#n;`` to the UTF-16 unit n (modulo 65536), without a UDF: what stands behind each ``&#`` is decoded alone.

    A unit that is half of a pair, alone, becomes U+FFFD.
    """
    parts = F.split(s, "&#", -1)

    def one(p: Column) -> Column:
        digits = F.regexp_extract(p, r"^(\d+);", 1)
        # The last digits alone decide modulo 65536 for what fits a decimal; longer ones are taken as they are.
        unit = F.pmod(digits.cast("decimal(38,0)"), F.lit(65536)).cast("long")
        char = F.decode(F.unhex(F.lpad(F.hex(unit), 4, "0")), "UTF-16BE")
        lone = unit.between(0xD800, 0xDFFF)
        rest = F.regexp_replace(p, r"^\d+;", "")
        return F.when(digits == "", F.concat(F.lit("&#"), p)).otherwise(F.concat(F.when(lone, F.lit("\ufffd")).otherwise(char), rest))

    tail = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), one)
    return F.when(F.instr(s, "&#") > 0, F.concat(F.get(parts, F.lit(0)), F.array_join(tail, ""))).otherwise(s)


# Fixed values, down to anchors(): the tags, entities and attributes that the cells and links of a page are read by.


def clean_html(s: Column) -> Column:
    """A cell's text: tags to spaces, then numeric entities, odd spaces, ampersands, apostrophes, quotes and spaces, in
    this order; so ``&amp;quot;`` is decoded twice."""
    s = decode_numeric(F.regexp_replace(s, "<[^>]+>", " "))
    s = F.replace(F.regexp_replace(s, f"[{ZERO_WIDTH}{NBSP}]", " "), F.lit("&amp;"), F.lit("&"))
    return _entities(F.regexp_replace(s, "&#0?39;|&apos;|&rsquo;", "'"))


def clean_portal(s: Column) -> Column:
    """As :func:`clean_html`, for pages without other numeric entities or odd spaces."""
    s = F.replace(F.regexp_replace(s, "<[^>]+>", " "), F.lit("&amp;"), F.lit("&"))
    return _entities(F.regexp_replace(s, "&#39;|&apos;", "'"))


def _entities(s: Column) -> Column:
    return squeeze(replace_all(s, {"&quot;": '"', "&nbsp;": " "}))


def table_rows(html: Column, cell: Column | None = None, numbered: bool = False, clean=clean_html) -> Column:
    """A page's table rows as array<array<string>> of cleaned cells; ``numbered`` takes rows with data-ri alone, and
    leaves their first cell out."""
    tag = r'<tr[^>]*data-ri="\d+"[^>]*>' if numbered else "<tr[^>]*>"
    rows = F.regexp_extract_all(html, F.lit(tag + r"([\s\S]*?)</tr>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"<td[^>]*>([\s\S]*?)</td>"), F.lit(1)), clean))


def anchors(html: Column, href: str = '[^"]+') -> Column:
    """A page's anchors in order, as array<struct<href, inner>>; only double-quoted hrefs count."""
    pattern = F.lit(rf'(?is)<a\s[^>]*href="({href})"[^>]*>(.*?)</a>')
    return F.arrays_zip(F.regexp_extract_all(html, pattern, F.lit(1)).alias("href"), F.regexp_extract_all(html, pattern, F.lit(2)).alias("inner"))


def resolve_url(href: Column, base: str) -> Column:
    """Hrefs that begin with "http" as they are, others put behind ``base``."""
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base), href))


def escape_html(s: Column) -> Column:
    """&, < and >, not quotes."""
    return replace_all(s, {"&": "&amp;", "<": "&lt;", ">": "&gt;"})


def slug(*parts: Column) -> Column:
    """Lower case, anything but a-z and 0-9 to single dashes, none at the ends; parts joined by a colon."""
    one = [F.regexp_replace(F.regexp_replace(F.lower(p), "[^a-z0-9]+", "-"), "^-+|-+$", "") for p in parts]
    return F.concat_ws(":", *one)


# What an e-mail address and a telephone number look like.


def email_valid(s: Column) -> Column:
    return F.trim(s).rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")


def phone_valid(s: Column) -> Column:
    """Digits with an optional plus and no leading zero, once spaces, dashes and brackets are gone."""
    return F.regexp_replace(F.trim(s), r"[\s\-\(\)]", "").rlike(r"^\+?[1-9]\d{0,15}$")


def filled(s: Column) -> Column:
    """A required field has more than white space."""
    return F.coalesce(F.trim(s) != "", F.lit(False))


def ease_out(n: Column, progress: Column) -> Column:
    """A counter's value at ``progress`` (0 to 1, more counts as 1) of a quartic ease-out."""
    return F.floor(n * (F.lit(1.0) - F.pow(F.lit(1.0) - F.least(progress, F.lit(1.0)), F.lit(4.0)))).cast("long")


def signed(n: Column) -> Column:
    """With sign and thousands separators."""
    return F.format_string("%+,d", n)


def direction(n: Column) -> Column:
    return F.when(n < 0, "down").when(n > 0, "up").otherwise("flat")


#: The least patients of each size word.
SIZE_WORDS = ((100_000, "Very large"), (50_000, "Large"), (25_000, "Mid-size"), (10_000, "Small"))


def size_word(n: Column, steps: Sequence[tuple[int, str]] = SIZE_WORDS, least: str = "Very small") -> Column:
    out = None
    for at, word in steps:
        out = F.when(n >= at, word) if out is None else out.when(n >= at, word)
    return out.otherwise(least)


def rural_score(rural: Column, special: Column) -> Column:
    """0.80 for rural and 0.10 for urban places, and 0.15 more for any special population."""
    return F.when(rural, 0.80).otherwise(0.10) + F.when(special, 0.15).otherwise(0.0)


def percent_change(now: Column, then: Column) -> Column:
    """0.0 where there was nothing before."""
    return F.when(then != 0, (now - then).cast("double") / then.cast("double") * 100.0).otherwise(F.lit(0.0))
