"""Text metrics of posts as column expressions; only the entity table of HTML needs Python."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that mark a title as a question.
WH_WORDS = ("how", "what", "why", "when", "where", "who", "which")
#: White space as Python's str.split takes it, inside a character class.
_WHITE = r"\s\x0b\x1c-\x1f\x85   -     　"
#: The block of code and the tags that are counted.
_PRE = r"(?s)<pre[^>]*>.*?</pre>"


def unescape(c: Column) -> Column:
    """Entities replaced by Python's table, in batches; rows without an ampersand keep their text."""

    def replaced(s: pd.Series) -> pd.Series:  # defined here, so that it travels to executors whole
        return s.map(html.unescape, na_action="ignore")

    return F.when(F.instr(c, "&") > 0, F.pandas_udf(replaced, StringType())(c)).otherwise(c)


def _matches(c: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"[{_WHITE}]+"), lambda w: w != "")


def title_metrics(title: Column) -> dict[str, Column]:
    """Length, words and whether the title asks (ends in '?' or begins with a wh-word); null for null or empty."""
    t = F.regexp_replace(title, f"^[{_WHITE}]+|[{_WHITE}]+$", "")
    w = words(t)
    some = F.length(title) > 0
    asks = t.endswith("?") | F.coalesce(F.lower(F.get(w, F.lit(0))), F.lit("")).isin(*WH_WORDS)
    return {"title_len_chars": F.when(some, F.length(t)), "title_len_words": F.when(some, F.size(w)), "title_is_question": F.when(some, asks.cast("int"))}


def body_metrics(body: Column) -> dict[str, Column]:
    """Thirteen counts of an HTML body: code in <pre> is measured apart from the prose; null for null or empty.

    The body's length is its code and its prose with white space reduced to single spaces.
    """
    some = F.length(body) > 0
    code = F.transform(F.regexp_extract_all(body, F.lit(_PRE), F.lit(0)), lambda c: F.regexp_replace(c, "<[^>]+>", ""))
    # a separator that unescaping cannot make keeps the blocks' lengths summable in one call
    code_len = F.length(unescape(F.array_join(code, "\x00"))) - F.greatest(F.size(code) - 1, F.lit(0))
    rest = F.regexp_replace(body, _PRE, " ")
    prose = unescape(F.regexp_replace(rest, "<[^>]+>", " "))
    w = words(prose)
    n, chars = F.size(w), F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x))
    out = {"body_len_chars": chars + F.greatest(n - 1, F.lit(0)) + code_len, "body_len_words": n, "n_code_blocks": F.size(code)}
    tags = {"n_inline_code": "code", "n_paragraphs": "p", "n_links": "a", "n_images": "img", "n_lists": "[uo]l", "n_blockquotes": "blockquote"}
    out |= {k: _matches(rest, rf"<{t}[\s>]") for k, t in tags.items()}
    out |= {"code_len_chars": code_len, "n_sentences": _matches(prose, "[.!?]+"), "n_long_words": F.size(F.filter(w, lambda x: F.length(x) > 6)), "avg_word_len_chars": F.when(n > 0, F.round(chars / n, 2)).otherwise(0.0)}
    return {k: F.when(some, v) for k, v in out.items()}
