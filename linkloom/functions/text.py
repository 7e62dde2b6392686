"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions import vocab as V


def fixed(df: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """keep and the named columns, computed once here.

    Filters and projections above would otherwise each repeat a long expression; a generator of one row isn't
    merged with them.
    """
    made = F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    return df.select(*keep, made)


def blank_to_null(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t == "", None).otherwise(t)


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that is worked out once, however often f names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def _ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def unaccent(c: Column) -> Column:
    """Latin letters without their accents; other scripts stay (see unaccent_any)."""
    return once(c, lambda x: F.when(_ascii(x), x).otherwise(F.translate(x, V.ACCENTED, V.PLAIN)))


@F.pandas_udf(T.StringType())
def unaccent_any(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility decomposition without combining marks, for text beyond Latin letters, in Arrow batches."""
    import unicodedata

    for s in parts:
        yield s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def collapse(c: Column) -> Column:
    """Single blanks for all runs of white space.  Most texts have nothing to fold, and tests for that are cheap."""

    def of(x: Column) -> Column:
        other = F.contains(x, F.lit("  "))
        for sign in "\t\n\x0b\f\r":
            other = other | F.contains(x, F.lit(sign))
        return F.trim(F.when(other, F.regexp_replace(x, r"\s+", " ")).otherwise(x))

    return once(c, of)


def normalize(c: Column, apostrophes: bool = True) -> Column:
    """No accents, lower case, one kind of apostrophe, single blanks."""
    if not apostrophes:
        return collapse(F.lower(unaccent(c)))
    plain = lambda x: F.when(_ascii(x), F.replace(x, F.lit("`"), F.lit("'"))).otherwise(F.translate(x, V.ACCENTED + "’`", V.PLAIN + "''"))
    return collapse(F.lower(once(c, plain)))


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(unaccent(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def tokens_padded(c: Column) -> Column:
    """Normalised words with a blank on either side of each run, so that whole words can be told by ' word '."""
    return padded(normalize(c))


def padded(norm: Column) -> Column:
    """tokens_padded of a text that is normalised already."""
    return F.concat(F.lit(" "), F.regexp_replace(norm, "[^a-z0-9]+", " "), F.lit(" "))


def clean(c: Column) -> Column:
    """Drops control characters, joins words hyphenated over a line break, then folds line breaks and blanks.

    The hyphens are joined before carriage returns become line breaks.
    """
    plain = F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f�]", "")
    out = F.regexp_replace(plain, r"([\p{L}\p{N}_])-[\s]*\n[\s]*([\p{L}\p{N}_])", "$1$2")
    out = F.regexp_replace(F.translate(out, "\r", "\n"), r"\s*\n\s*", " ")
    blanks = lambda x: F.trim(F.regexp_replace(x, "[\t ][ \t ]*| [ \t ]+", " "))
    # most blocks are single lines, in which only blanks are left to fold
    return F.when(F.contains(c, F.lit("\n")) | F.contains(c, F.lit("\r")), blanks(out)).otherwise(blanks(plain))


def is_noise(c: Column) -> Column:
    """Numbers alone, short capitals or page labels, a lone URL."""
    numbers = c.rlike(r"^[\d\s\-–—|.·]+$")
    capitals = (c == F.upper(c)) & (c != F.lower(c))
    label = F.lower(c).rlike(r"^(p\.|pág\.|página)\s*\d+")
    return numbers | ((F.length(c) < 60) & (capitals | label)) | c.rlike(r"^https?://\S+$")


def continues(previous: Column, following: Column) -> Column:
    """Whether a block goes on in the next: no terminal sign, then a small letter or a closing sign."""
    last, first = F.substring(previous, -1, 1), F.substring(following, 1, 1)
    small = (first == F.lower(first)) & (first != F.upper(first))
    return F.coalesce((previous != "") & (following != "") & ~F.array_contains(F.array(*map(F.lit, ".!?:;\"”’)»]")), last) & (small | first.isin(",", ";", ")")), F.lit(False))


def clean_name(c: Column) -> Column:
    """A person's name without signs, trailing brackets and any number of leading titles."""
    out = F.regexp_replace(F.trim(c), r"^[,.;:]+|[,.;:]+$", "")
    out = F.regexp_replace(out, r"\s*[\(\[].*?[\)\]]\s*$", "")
    titles = "|".join(V.TITLES)
    return collapse(F.regexp_replace(out, rf"(?i)^((?:(?:os|as|do|da|de|dos|das|o|a)?\s*(?:{titles})\s+))+", ""))


def surname(c: Column) -> Column:
    """The part before a comma; else the last word that is no suffix and longer than two letters; else the last."""
    parts = F.filter(F.split(c, r"[\s,]+"), lambda x: x != "")
    good = F.filter(parts, lambda x: ~F.lower(x).isin(V.SURNAME_SUFFIXES) & (F.length(x) > 2))
    return F.when(F.contains(c, F.lit(",")), F.get(parts, F.lit(0))).when(F.size(good) > 0, F.element_at(good, -1)).otherwise(F.get(parts, F.size(parts) - 1))


def source_type(name: Column, text: Column) -> Column:
    n = normalize(F.concat(name, F.lit(" "), F.substring(text, 1, 600)))
    has = lambda *xs: n.rlike("|".join(xs))
    return (
        F.when(has("tcc", "trabalho de conclusao", "trabalho final de graduacao"), "tcc").when(has("dissert", "mestrado"), "dissertacao")
        .when(has("(^|[^a-z0-9_])tese([^a-z0-9_]|$)", "doutorado"), "tese").when(has("arquitextos", "revista", "vitruvius", "artigo"), "artigo")
        .when(has("anais", "seminario", "docomomo"), "anais").otherwise("outro")
    )


def years(c: Column) -> Column:
    """All years from 1920 to 2029 that stand alone, with repeats."""
    padded = F.regexp_replace(F.concat(F.lit(" "), c, F.lit(" ")), r"[^0-9A-Za-z_]", "  ")
    return F.transform(F.regexp_extract_all(padded, F.lit(r" (19[2-9][0-9]|20[0-2][0-9]) "), F.lit(1)), lambda x: x.cast("int"))


def modal_year(c: Column) -> Column:
    """The most frequent year, the latest among equals."""
    all_ = years(c)
    counted = F.transform(F.array_distinct(all_), lambda y: F.struct(F.size(F.filter(all_, lambda z: z == y)).alias("n"), y.alias("y")))
    return F.array_max(counted)["y"]


def author(name: Column, declared: Column) -> Column:
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    said = F.regexp_extract(stem, r"(?i)^(?:DISSERTA[ÇC][ÃA]O|TESE|TCC)\s+(.+?)(?:\s*\(\d+\))?$", 1)
    usable = (F.length(declared) > 3) & ~F.lower(declared).rlike(r"@|\.com|user|admin|windows|microsoft")
    return F.when(said != "", F.trim(F.translate(said, "_", " "))).when(usable, declared)


def is_bibliography(c: Column) -> Column:
    """Many authors as in a list of references, or many of its marks."""

    def some(low: Column) -> Column:
        found = low.rlike(r"[pvn]\. \d")
        for part in V.REFERENCE_PARTS:
            found = found | F.contains(low, F.lit(part))
        return found

    # a text is searched for authors (marks) only if it holds the end of one (a part of one)
    authors = lambda x: F.when(x.rlike(V.REFERENCE_AUTHOR_END), F.regexp_count(x, F.lit(V.REFERENCE_AUTHOR))).when(x.isNotNull(), 0)
    marks = lambda x: F.when(once(F.lower(x), some), F.regexp_count(x, F.lit(V.REFERENCE_MARKS))).when(x.isNotNull(), 0)
    many = lambda n: (n["authors"] >= 3) | ((n["authors"] >= 1) & (n["marks"] >= 3)) | (n["marks"] >= 5)
    return once(c, lambda x: once(F.struct(authors(x).alias("authors"), marks(x).alias("marks")), many))


def is_literal(excerpt: Column, text: Column) -> Column:
    """Whether an excerpt stands in a text, up to case and blanks; accents count."""
    fold = lambda c: F.lower(collapse(c))
    return F.coalesce((fold(excerpt) != "") & F.contains(fold(text), fold(excerpt)), F.lit(False))


def json_blob(c: Column) -> Column:
    """From the first to the last brace; null without."""
    found = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def unknown_names(c: Column, known: Column | None = None, common: list[str] = V.NOT_NAMES) -> Column:
    """Distinct runs of two to five capitalised words, none of them a common word, that hold none of the known phrases.

    known: an array of phrases as words parted by blanks.
    """
    found = F.regexp_extract_all(c, F.lit(V.NAME_START + V.NAME_PATTERN), F.lit(1))
    main = lambda x: F.filter(F.split(x, r"\s+"), lambda t: ~F.lower(t).isin(V.NAME_LINKS))
    fine = F.filter(found, lambda x: (F.size(main(x)) >= 2) & ~F.exists(main(x), lambda t: normalize(t).isin(common)))
    names = F.array_distinct(F.transform(fine, lambda x: normalize(x)))
    if known is None:
        return names
    return F.filter(names, lambda x: ~F.exists(known, lambda p: F.contains(tokens_padded(x), F.concat(F.lit(" "), p, F.lit(" ")))))


def prompt(source: Column, page: Column, before: Column, text: Column, after: Column, known: Column, unknown: Column) -> Column:
    """The message that asks for the relations of one paragraph, with its context and the names found in it as hints."""
    given = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "(nenhum)").otherwise(c)
    names = F.concat(F.array_sort(F.array_distinct(known)), unknown)
    hints = F.when(F.size(names) > 0, F.concat(F.lit("\n\nNomes detectados automaticamente no parágrafo-alvo (apenas pistas; não invente vínculos para eles): "), F.array_join(names, "; "))).otherwise("")
    return F.concat(
        F.lit("FONTE: "), F.coalesce(source, F.lit("")), F.lit("\nPÁGINA: "), page.cast("string"), F.lit("\n\n[CONTEXTO ANTERIOR]\n"), given(before),
        F.lit("\n\n[PARÁGRAFO-ALVO]\n"), text, F.lit("\n\n[CONTEXTO POSTERIOR]\n"), given(after), hints,
    )


def citation(author: Column, year: Column, page: Column) -> Column:
    """Author (year), p. N; s.d. without a year, nothing without a page."""
    return F.concat(F.coalesce(blank_to_null(author), F.lit("?")), F.lit(" ("), F.coalesce(year.cast("string"), F.lit("s.d.")), F.lit(")"), F.coalesce(F.concat(F.lit(", p. "), blank_to_null(page.cast("string"))), F.lit("")))


def is_slug(c: Column) -> Column:
    """Whether a text may name a source's folder: a slug, "manual" or "_"."""
    return F.coalesce(c.rlike(V.ID_FORMAT) | c.isin("manual", "_"), F.lit(False))
