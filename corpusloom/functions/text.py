"""Scalar text expressions: Column to Column, JVM-side but for nfkc."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split sees it.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def nfkc(c: Column) -> Column:
    """Unicode form NFKC, which Spark lacks: the one Arrow function here. ASCII is in that form and isn't sent."""

    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))

    return F.coalesce(form(F.when(~is_ascii(c), c)), c)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """Single spaces. No condition names the text twice: Spark would compute it twice."""
    return F.regexp_replace(F.translate(c, SPACES, " " * len(SPACES)), " {2,}", " ")


def pair_key(c: Column, unicode: bool = True) -> Column:
    """NFKC, strip, lower, single spaces."""
    return collapse(F.lower(strip(nfkc(c) if unicode else c)))


#: Typographic punctuation and what stands for it.
PUNCTUATION = {
    "，": ",", "、": ",", "”": '"', "“": '"', "∶": ":", "：": ":", "？": "?", "《": '"', "》": '"', "）": ")", "！": "!", "（": "(", "；": ";", "」": '"', "「": '"',
    "０": "0", "１": "1", "２": "2", "３": "3", "４": "4", "５": "5", "６": "6", "７": "7", "８": "8", "９": "9",
    "～": "~", "’": "'", "━": "-", "〈": "<", "〉": ">", "【": "[", "】": "]", "％": "%",
}
#: Those that become a full stop and a space, and take the white space after them along.
SENTENCE_ENDS = "。．"


def dedup_key(c: Column, unicode: bool = True) -> Column:
    """Characters that don't print out, typographic punctuation to ASCII, NFKC, strip, single spaces, lower."""
    wide = F.regexp_replace(c, r"\p{C}", "")
    wide = F.replace(F.translate(wide, "".join(PUNCTUATION), "".join(PUNCTUATION.values())), F.lit("…"), F.lit("..."))
    wide = F.regexp_replace(wide, f"[{SENTENCE_ENDS}][{SPACES}]*", ". ")
    wide = collapse(strip(nfkc(wide) if unicode else wide))
    # Plain text has none of all that but control characters and spaces that stand together.
    plain = F.trim(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1f\x7f]", ""), " {2,}", " "))
    return F.lower(F.when(is_ascii(c), plain).otherwise(wide))


def regex_clean(c: Column) -> Column:
    """The eight-step cleaner (its classes are fixed values): controls (tabs too) and CR out, escaped newlines to spaces, single spaces, no trailing space, no BOM."""
    for a, b in ((r"[\x01-\x09\x0B\x0C\x0E-\x1D\x7F]", ""), (r"\r", ""), (r"\\\\ ?[rn]", " "), (r"\\ ?[rn]", " "), (r" +", " "), (r" +\z", ""), (r"\A\x{FEFF}", "")):
        c = F.regexp_replace(c, a, b)
    return c


def n_words(c: Column) -> Column:
    """How many words: the spaces of the evened text and one."""
    even = strip(collapse(c))
    return F.when(even == "", 0).otherwise((F.octet_length(even) - F.octet_length(F.replace(even, F.lit(" "), F.lit(""))) + 1).cast("int"))


def quality_verdict(c: Column) -> Column:
    """ok, or the first rule broken: len (6 to 80 tokens), url, upper (over half of the letters), alpha (under 0.6 of tokens with a letter)."""
    n, letters, upper = n_words(c), F.regexp_count(c, F.lit(r"\p{L}")), F.regexp_count(c, F.lit(r"\p{Lu}"))
    worded = F.regexp_count(collapse(c), F.lit(r"[^ ]*?\p{L}[^ ]*"))
    return (
        F.when((n < 6) | (n > 80), "len")
        .when(c.rlike(r"https?://|www\."), "url")
        .when(upper > 0.5 * letters, "upper")
        .when(worded < 0.6 * n, "alpha")
        .otherwise("ok")
    )


def pair_verdict(src: Column, tgt: Column, malformed: Column | None = None) -> Column:
    """kept, or the first of malformed, empty, len_ratio, repeat, echo."""
    s, t = strip(src), strip(tgt)
    a, b = F.length(s), F.length(t)
    return (
        F.when(F.coalesce(malformed, F.lit(False)) if malformed is not None else F.lit(False), "malformed")
        .when(b < 3, "empty")
        .when((b < 0.5 * a) | (b > 2.0 * a), "len_ratio")
        .when(t.rlike(r"(?U)\b(\S+)(?:\s+\1\b){3,}"), "repeat")
        .when(F.lower(s) == F.lower(t), "echo")
        .otherwise("kept")
    )


#: Names that the target languages go by.
TARGETS = ("en", "de", "pl", "cs", "sk", "sl")
SYNONYMS = {
    "eng": "en", "deu": "de", "pol": "pl", "ces": "cs", "slk": "sk", "slv": "sl",
    "english": "en", "german": "de", "polish": "pl", "czech": "cs", "slovak": "sk", "slovenian": "sl",
}


def language(c: Column, synonyms: dict[str, str] = SYNONYMS) -> Column:
    named = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
    code = F.lower(strip(c))
    return F.coalesce(F.try_element_at(named, code), code)


def language_column(columns: list[str]) -> str | None:
    return next((c for c in ("language", "lang", "locale", "language_code") if c in columns), None)


def extract_tagged(c: Column, tag: str) -> Column:
    """What follows <tag> on its line, up to </tag> or the end of the turn."""
    cut = F.substring_index(F.substring_index(c, f"</{tag}>", 1), "<|im_end|>", 1)
    found = F.regexp_extract(cut, rf"<{tag}>[{SPACES}]*([^\n]+)", 1)
    return F.when(found == "", "[invalid]").otherwise(strip(found))


def first_line(c: Column) -> Column:
    return strip(F.substring_index(c, "\n", 1))


def filled_pairs(df, src: str = "src", tgt: str = "tgt"):
    """Rows with text on both sides."""
    return df.where((F.coalesce(F.col(src), F.lit("")) != "") & (F.coalesce(F.col(tgt), F.lit("")) != ""))
