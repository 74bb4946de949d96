"""Cleaning of texts and tags from feeds and readers; what needs Unicode tables or character references goes through Arrow batches."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Unicode white space; what no tag may hold; lengths of tags in characters.
SPACE = re.compile("[\t\n\x0b\x0c\r \x85\xa0  -     　]+")
BANNED = ["://", "www.", "<", ">", "&#", "\\u", "{", "}"]
SHORTEST, LONGEST = 2, 60
MARKUP = re.compile(r"</?[a-zA-Z][^>]*>")


def _spaced(text: str) -> str:
    return SPACE.sub(" ", text).strip(" ")


def plain_text(text: str | None, passes: int = 3) -> str | None:
    """A text without markup: character references are decoded until nothing changes (feeds encode them twice), tags become blanks, white space one blank."""
    if text is None or ("&" not in text and "<" not in text):
        return text
    for _ in range(passes):
        decoded = html.unescape(text)
        if decoded == text:
            break
        text = decoded
    return _spaced(MARKUP.sub(" ", text))


def tag_text(raw: str | None, passes: int = 4) -> str | None:
    """A reader's tag in one form, or None if it's none: compatibility-composed, lower case, single blanks, 2 to 60 characters, no control characters, addresses or markup."""
    if raw is None:
        return None
    text = _spaced(unicodedata.normalize("NFKC", raw))
    if any(unicodedata.category(c) == "Cc" for c in text):
        return None
    for _ in range(passes):
        folded = unicodedata.normalize("NFKC", text.lower())
        if folded == text:
            break
        text = folded
    else:
        return None
    return text if SHORTEST <= len(text) <= LONGEST and not any(b in text for b in BANNED) else None


@F.pandas_udf(StringType())
def clean_text(texts: pd.Series) -> pd.Series:
    return texts.map(plain_text, na_action="ignore")


@F.pandas_udf(StringType())
def folk_tag(tags: pd.Series) -> pd.Series:
    return tags.map(tag_text, na_action="ignore")


def xml_text(c: Column) -> Column:
    """Without the characters that XML 1.0 doesn't allow."""
    return F.regexp_replace(c, r"[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")
