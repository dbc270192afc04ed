"""Text functions on columns: normal forms, keys, tokens, phrases. All run inside Catalyst."""
from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
# Function words that neither topic phrases nor selected n-grams may consist of.
STOPWORDS = "và của các những trong trước sau cho về việc để tại theo là ở có khi này đó với một nhiều được đang cần".split()


def _folding() -> tuple[str, str]:
    """Letters with accents and the plain letters that they decompose to."""
    letters = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(a, b) for a, b in letters if a != b and b.isascii() and b.isalpha()] + [("đ", "d"), ("Đ", "D")]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _folding()


def norm_space(x: Column | str) -> Column:
    """Runs of white space, Unicode's included, as one space; none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"(?U)[\s﻿]+", " "))


def norm_key(x: Column | str) -> Column:
    return F.lower(norm_space(x))


def ascii_key(x: Column | str) -> Column:
    """Lower case without accents; đ as d."""
    return F.lower(F.translate(F.regexp_replace(norm_space(x), r"\p{Mn}+", ""), ACCENTED, PLAIN))


def slug(x: Column | str) -> Column:
    plain = F.trim(F.regexp_replace(norm_key(x), "[^a-z0-9à-ỹ]+", "_"), F.lit("_"))
    return F.when(plain == "", "document").otherwise(plain)


def truncate(x: Column | str, limit: int) -> Column:
    """Collapsed; where longer than ``limit``, cut so that three dots fit."""
    text = norm_space(x)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, limit - 3)), F.lit("...")))


def absent_as_null(x: Column | str) -> Column:
    return F.nullif(F.trim(_c(x)), F.lit(""))


def tokens(x: Column | str) -> Column:
    return F.regexp_extract_all(norm_key(x), F.lit(f"({WORD})"), 1)


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words joined by a space; none where there are fewer."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def _is_stopword(w: Column) -> Column:
    return w.isin(STOPWORDS)


def selected_ngrams(words: Column) -> Column:
    """Bigrams, then trigrams, of the words that are no stopwords, without those that hold an underscore."""
    clean = F.filter(words, lambda w: ~_is_stopword(w))
    return F.filter(F.concat(ngrams(clean, 2), ngrams(clean, 3)), lambda g: ~F.contains(g, F.lit("_")))


def topic_phrases(x: Column | str) -> Column:
    """Distinct trigrams, then bigrams, with two or more words that are no stopwords."""
    words = tokens(x)
    weighty = lambda g: F.size(F.filter(F.split(g, " "), lambda w: ~_is_stopword(w))) >= 2
    return F.array_distinct(F.filter(F.concat(ngrams(words, 3), ngrams(words, 2)), weighty))


# Words that introduce a reference, and the two tokens that one gives.
REFERENCE_WORDS = [("điều", r"điều\s+(\d+)", "article"), ("khoản", r"khoản\s+(\d+)", "clause"), ("điểm", r"điểm\s+([a-zđ])", "point")]


def reference_tokens(x: Column | str) -> Column:
    """điều_6 and article_6 for "Điều 6", and the like."""
    raw = norm_key(x)

    def both(word: str, pattern: str, english: str) -> Column:
        return F.flatten(F.transform(F.regexp_extract_all(raw, F.lit(pattern), 1), lambda n: F.array(F.concat(F.lit(f"{word}_"), n), F.concat(F.lit(f"{english}_"), n))))

    return F.concat(*(both(*r) for r in REFERENCE_WORDS))


def search_tokens(x: Column | str) -> Column:
    """Words, reference tokens and selected n-grams in turn."""
    return F.concat(tokens(x), reference_tokens(x), selected_ngrams(tokens(x)))


def phrase_overlap(phrases: Column, text: Column | str) -> Column:
    """Share of the phrases that the text holds; 0 without phrases."""
    hay = norm_key(text)
    return F.when(F.size(phrases) > 0, F.size(F.filter(phrases, lambda p: F.contains(hay, p))) / F.size(phrases)).otherwise(F.lit(0.0))


def repair_mojibake(x: Column | str) -> Column:
    """UTF-8 that was read as Latin-1, put right up to twice; anything else is left as it is.

    The bytes are rebuilt with hex so that an unfit text is noticed before it is decoded.
    """
    text = F.coalesce(_c(x), F.lit(""))
    marked = r"Ã|Ä|Â|áº|á»"
    for _ in range(2):
        fits = text.rlike(marked) & ~text.rlike(r"[^\x00-\xFF]")
        raw = F.encode(F.when(fits, text).otherwise(F.lit("")), "ISO-8859-1")
        text = F.when(fits, F.coalesce(F.try_validate_utf8(raw.cast("string")), text)).otherwise(text)
    return text


def uuid5(namespace_hex: str, name: Column) -> Column:
    """RFC 4122 version 5 of a name in a namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x
