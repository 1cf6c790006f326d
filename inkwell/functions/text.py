"""Text rules as column expressions: words, short-word n-grams, HTML, phrases. No Python runs per row."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words: everything but letters and digits.
SEPARATORS = r"[^\p{L}\p{N}]+"
_DROPPED = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[^>]*>"


def words(text: Column, lowercase: bool = True) -> Column:
    """The words of a text in order; null has none."""
    folded = F.lower(text) if lowercase else text
    return F.array_remove(F.split(F.coalesce(folded, F.lit("")), SEPARATORS), "")


def query_words(text: str, lowercase: bool = True) -> list[str]:
    """`words` for a request on the driver."""
    out, word = [], []
    for c in text.lower() if lowercase else text:
        if unicodedata.category(c)[0] in "LN":
            word.append(c)
        elif word:
            out.append("".join(word))
            word = []
    return [*out, "".join(word)] if word else out


def tokens(text: Column, short: int = 0, lowercase: bool = True) -> Column:
    """(token, pos) of a text, positions from 0.

    With `short` > 0 a word of fewer characters gives, at its position, the word before it joined to it and it joined
    to the word after it; alone it gives nothing.
    """
    all_words = words(text, lowercase)
    if short <= 0:
        return F.transform(all_words, lambda t, i: F.struct(t.alias("token"), i.alias("pos")))

    def fused(ws: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            pair = F.filter(F.array(F.concat(F.get(ws, i - 1), t), F.concat(t, F.get(ws, i + 1))), lambda x: x.isNotNull())
            return F.transform(F.when(F.length(t) < short, pair).otherwise(F.array(t)), lambda x: F.struct(x.alias("token"), i.alias("pos")))

        return F.flatten(F.transform(ws, one))

    # bound to a variable first: a lambda would cut the text anew for each word
    return F.transform(F.array(all_words), fused)[0]


def query_tokens(text: str, short: int = 0, lowercase: bool = True) -> list[str]:
    """`tokens` for a request, without positions."""
    ws = query_words(text, lowercase)
    out: list[str] = []
    for i, w in enumerate(ws):
        if short <= 0 or len(w) >= short:
            out.append(w)
        else:
            out += [a + b for a, b in ((ws[i - 1] if i else "", w), (w, ws[i + 1] if i + 1 < len(ws) else "")) if a and b]
    return out


def html_text(html: Column) -> Column:
    """Text of HTML: comments, scripts, styles and tags become spaces; entities stay as they are."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), _DROPPED, " ")


def content_words(content: Column) -> Column:
    """Words of stored content, as exact matching sees them."""
    return words(html_text(content))


def has_phrase(content: Column, phrase: list[str]) -> Column:
    """Whether the words of the content hold the phrase as consecutive words: words have no spaces, so joined text will do."""
    if not phrase:
        return F.lit(True)
    return F.contains(F.concat(F.lit(" "), F.array_join(content_words(content), " "), F.lit(" ")), F.lit(f" {' '.join(phrase)} "))


def any_word(content: Column, unwanted: list[str]) -> Column:
    """Whether the words of the content hold any of these."""
    return F.arrays_overlap(content_words(content), F.array(*[F.lit(w) for w in unwanted])) if unwanted else F.lit(False)


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title", 1))


def page_links(html: Column) -> Column:
    """Values of double-quoted href attributes in order."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit('href="([^"]*)"'), F.lit(1))


def join_text(items: Column, separator: str = " ") -> Column:
    return F.array_join(items, separator)
