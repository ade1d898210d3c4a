"""Column functions over text. Every one is a built-in expression, so it stays
in the JVM and can sit in any select, filter or stream."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Whitespace as Unicode-aware text processing sees it, written for Java's
# regex engine whose \s is ASCII only.
WS = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Line terminators beyond \n that end a line of extracted page text.
LINE_BREAK = r"(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}])"

# The stopword list of the tokeniser.
STOPWORDS = (
    "a an the and or but if of to in on for with as by is are was were be "
    "been being this that these those it its from at into over under "
    "between we our their they he she his her them you your i not no "
    "can could will would should may might do does did have has had"
).split()


# The same characters as one string, for trimming without a regex.
WS_CHARS = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
         0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def clean_text(c: Column) -> Column:
    """Runs of whitespace to one blank, trimmed; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), rf"{WS}+", " "))


def name_key(c: Column) -> Column:
    """Identity of an entity or author name."""
    return F.lower(strip(c))


def normalize_title(c: Column) -> Column:
    """Lower case, everything but [a-z0-9] to single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def tokenize(c: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Lower-cased alphanumeric runs of two or more characters, stopwords removed."""
    runs = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{2,}"), F.lit(0))
    if not stopwords:
        return runs
    return F.filter(runs, lambda t: ~t.isin(*stopwords))


def parse_utc(c: Column) -> Column:
    """Strict UTC second-resolution timestamp; anything else is null."""
    shaped = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"), c)
    return F.try_to_timestamp(shaped, F.lit("yyyy-MM-dd'T'HH:mm:ssX"))


def arxiv_id(c: Column) -> Column:
    """Feed id URL to bare id; the version suffix stays."""
    return F.substring_index(F.regexp_replace(strip(c), "/+$", ""), "/abs/", -1)


def arxiv_base_id(c: Column) -> Column:
    """Bare id without its version, for optional cross-source dedupe."""
    return F.regexp_replace(c, r"v\d+$", "")


def first_percentage(c: Column) -> Column:
    """First '<1-3 digits>[.digits] %' figure in the text, as a double."""
    hit = F.regexp_extract(c, r"(\d{1,3}(?:\.\d+)?)\s*%", 1)
    return F.when(hit != "", hit).try_cast("double")


def first_year(c: Column) -> Column:
    hit = F.regexp_extract(c, r"(?U)\b(?:19|20)\d{2}\b", 0)
    return F.when(hit != "", hit).try_cast("int")


def split_lines(c: Column) -> Column:
    """Lines of a page; a closing line break does not open another line."""
    body = F.regexp_replace(c, rf"{LINE_BREAK}\z", "")
    return F.when(
        F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")
    ).otherwise(F.split(body, LINE_BREAK))


def sentences(c: Column) -> Column:
    return F.split(c, rf"(?<=[.!?]){WS}+")


def prefix(c: Column, length: int, mark: str = "…") -> Column:
    """Display cut: at most ``length`` characters, with a mark if text was left out."""
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit(mark))).otherwise(c)


def join_first(items: Column, n: int, tail: str = ", et al.") -> Column:
    """First ``n`` names joined by commas, with a tail if there are more."""
    head = F.array_join(F.slice(items, 1, n), ", ")
    return F.when(F.size(items) > n, F.concat(head, F.lit(tail))).otherwise(head)


def or_empty(c: Column, element: str = "string") -> Column:
    """Null list as the empty list."""
    return F.coalesce(c, F.array().cast(f"array<{element}>"))


def capitalize_first(c: Column) -> Column:
    """Upper-case the first character only."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2147483647))


def stable_id(*parts: Column) -> Column:
    """Deterministic key of a natural key, same on every run and executor."""
    return F.sha2(F.concat_ws("\x01", *parts), 256)
