"""Column functions over titles, names, identifiers and labels."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_key(c: Column) -> Column:
    """Runs of anything but letters and digits become one blank; lower case; trimmed."""
    return F.trim(F.lower(F.regexp_replace(c, r"[^\p{L}\p{Nd}]+", " ")))


def norm_label(c: Column) -> Column:
    """Lower case, runs of any Unicode white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def title_core(c: Column) -> Column:
    """The title before its first ': ', if something stands before it."""
    return F.when(F.locate(": ", c) > 1, F.substring_index(c, ": ", 1)).otherwise(c)


def cluster_key(author: Column, title: Column, langs: Column) -> Column:
    """author, title and sorted languages joined by the unit separator; null for an empty title, which never clusters."""
    sep = "\x1f"
    return F.when(norm_key(title) != "", F.concat_ws(sep, norm_key(author), norm_key(title), F.array_join(F.array_sort(F.array_distinct(langs)), ",")))


def last_first(c: Column) -> Column:
    """First Middle Last -> Last, First Middle; one word or a name with a comma stays."""
    parts = F.split(F.trim(c), r" +")
    return F.when(F.contains(c, F.lit(",")) | (F.size(parts) < 2), F.trim(c)).otherwise(F.concat_ws(", ", F.element_at(parts, -1), F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), " ")))


def canon_uri(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^https?://", ""), r"/$", "")


def norm_isbn(c: Column) -> Column:
    """Digits and a final X only; null unless 10 or 13 characters are left."""
    s = F.upper(F.regexp_replace(c, r"[^0-9Xx]", ""))
    return F.when(F.length(s).isin(10, 13), s)


def idf(df: Column) -> Column:
    return 1 / F.log2(df + 2)


def split_role(c: Column) -> Column:
    """(name, role) of 'Name (role)'; without a trailing role in brackets it's null."""
    pattern = r"^(.*\S)\s*\(([^()]*)\)\s*$"
    hit = c.rlike(pattern)
    return F.struct(F.when(hit, F.regexp_extract(c, pattern, 1)).otherwise(F.trim(c)).alias("name"), F.when(hit, F.trim(F.regexp_extract(c, pattern, 2))).alias("role"))


def scheme_of(uri: Column, prefixes: Sequence[tuple[str, str]]) -> Column:
    """The scheme of the first prefix that fits, in the order given; null if none does."""
    out = F.lit(None).cast("string")
    for prefix, scheme in reversed(prefixes):
        out = F.when(F.startswith(uri, F.lit(prefix)), scheme).otherwise(out)
    return out


def split_list(c: Column) -> Column:
    """The trimmed, non-empty parts of a comma list."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def pick_label(labels: Column, prefer: Sequence[str] = ()) -> Column:
    """From a map language -> label: the first preferred one, English, untagged, else that of the smallest language; empty labels don't count."""
    full = F.map_filter(labels, lambda k, v: v != "")
    first = F.get(F.array_sort(F.map_keys(full)), F.lit(0))
    return F.coalesce(*[F.try_element_at(full, F.lit(lang)) for lang in [*prefer, "en", ""]], F.try_element_at(full, first))


def series_key(c: Column) -> Column:
    """A series title without its trailing punctuation, in lower case."""
    return F.lower(F.rtrim(c, F.lit(" ;:,.")))


def tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, in order."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def has_keywords(c: Column, keywords: str) -> Column:
    """Whether the keyword's words follow one another in the text; a word of the text may add -s or -es. No words: false."""
    words = [w for w in re.split("[^a-z0-9]+", keywords.lower()) if w]
    if not words:
        return F.lit(False)
    return F.concat(F.lit(" "), F.array_join(tokens(c), " "), F.lit(" ")).rlike(" " + " ".join(f"{w}(?:s|es)?" for w in words) + " ")


def singular(w: Column) -> Column:
    """A word without a plural ending: -ies to -y, -es, -s."""
    n = F.octet_length(w)
    cut = lambda k: F.left(w, F.length(w) - k)
    return F.when((n > 3) & w.endswith("ies"), F.concat(cut(3), F.lit("y"))).when((n > 3) & w.endswith("es"), cut(2)).when((n > 2) & w.endswith("s"), cut(1)).otherwise(w)


def plural_equal(a: Column, b: Column) -> Column:
    """Whether two headings agree word by word, apart from plural endings on either side."""
    of = lambda c: F.transform(F.filter(F.split(c, r"\s+"), lambda w: w != ""), singular)
    return of(a) == of(b)
