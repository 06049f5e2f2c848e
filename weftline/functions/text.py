"""Texts as columns: clean-up, tokens, terms, excerpts, codes; Python only where Unicode normalisation needs it."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import fixed as X

CJK = "㐀-鿿"
UNSEEN = re.compile(f"[{X.INVISIBLE}]")


def fold(text: str) -> str:
    """Invisible characters dropped, compatibility forms and case folded, ends stripped."""
    return unicodedata.normalize("NFKC", UNSEEN.sub("", text)).casefold().strip()


@F.pandas_udf(StringType())
def _fold(column: pd.Series) -> pd.Series:
    return column.map(lambda x: None if x is None else fold(x))


def folded(text: Column) -> Column:
    """``fold`` as a column. Printable ASCII, which most text is, stays in the JVM: Python gets null in its place."""
    plain = text.rlike(r"^[\x20-\x7E]*$")
    return F.when(plain, F.lower(F.trim(text))).otherwise(_fold(F.when(~plain, text)))


#: Links and parameters of links: they say nothing of what a resource is.
ADDRESS = r"(?:https?://|magnet:\?|[?&](?:pwd|password|code|public)=)\S+"


def evidence(text: Column) -> Column:
    """What of a folded text may name a resource."""
    return F.trim(F.regexp_replace(text, ADDRESS, " "))


def words(text: Column) -> Column:
    """ASCII words of a text, lower-cased, as an array."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def mixed_tokens(text: Column) -> Column:
    """Index tokens: Latin words and digits as they are; CJK runs, joined across what separates them until a word comes
    between, as overlapping pairs (a lone character as itself). Expects folded text."""
    joined = F.regexp_replace(text, rf"(?<=[{CJK}])[^a-z0-9{CJK}]+(?=[{CJK}])", "")
    # In one pass: what is ahead is a word, a pair, of which one character is gone past, or a character alone.
    return F.regexp_extract_all(joined, F.lit(rf"(?=([a-z0-9]+|[{CJK}]{{2}}|(?<![{CJK}])[{CJK}]))(?:[a-z0-9]+|[{CJK}])"), F.lit(1))


def is_cjk(c: str) -> bool:
    return "㐀" <= c <= "鿿"


def mixed_token_list(text: str) -> list[str]:
    """``mixed_tokens`` of a folded text on the driver."""
    runs: list[str] = []
    between = False
    for c in text:
        if is_cjk(c):
            if runs and is_cjk(runs[-1][-1]):
                runs[-1] += c
            else:
                runs.append(c)
        elif c.isascii() and c.isalnum():
            if runs and between is False and not is_cjk(runs[-1][-1]):
                runs[-1] += c
            else:
                runs.append(c)
        between = not (is_cjk(c) or c.isascii() and c.isalnum())
    return [t for r in runs for t in ([r[i : i + 2] for i in range(max(1, len(r) - 1))] if is_cjk(r[0]) else [r])]


def term_regex(term: str) -> str:
    """A Java regex for a term. Three kinds of terms differ in what may stand between their characters and what may not
    stand before or after them: names with CJK characters, where separators are nothing and a number is whole; Latin
    words, which begin where a word does and don't end within a longer name, while a version may follow; and the rest."""
    if any(map(is_cjk, term)):
        before, between, after = "", f"[{X.SEPARATORS}]*", "(?![0-9])" if term[-1].isdigit() else ""
    elif term[:1].isalpha() and all(c.isascii() and (c.isalnum() and not c.isupper() or c in "+#") for c in term):
        before, between, after = "(?<![a-z0-9])", "", "(?![a-z+#])"
    else:
        before = between = after = ""
    return before + between.join(map(_quote, term)) + after


def quoted(text: str) -> str:
    return "".join(map(_quote, text))


def _quote(text: str) -> str:
    return re.sub(r"([^\w\s]|_)", r"\\\1", text, flags=re.ASCII) if text.isascii() else text


def excerpt(text: Column, terms: Column, width: int) -> Column:
    """A text of one line: whole if it has ``width`` characters at most, else a window of so many around the first of
    ``terms``, in their order, that occurs, or the head if none does; ellipses where it is cut."""

    def cut(flat: Column) -> Column:
        places = F.filter(F.transform(terms, lambda t: F.position(F.lower(t), F.lower(flat))), lambda p: p > 0)
        start = F.greatest(F.lit(1), F.least(F.coalesce(F.get(places, F.lit(0)), F.lit(1)) - F.lit(width // 2), F.length(flat) - F.lit(width) + 1))
        ends = F.when(start + width - 1 < F.length(flat), "…").otherwise("")
        return F.concat(F.when(start > 1, "…").otherwise(""), F.substr(flat, start, F.lit(width)), ends)

    line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.get(F.transform(F.array(line), lambda flat: F.when(F.length(flat) <= width, flat).otherwise(cut(flat))), F.lit(0))


def shorten(text: Column, width: int) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > width, F.concat(F.substr(flat, F.lit(1), F.lit(width - 1)), F.lit("…"))).otherwise(flat)


def code_in_text(text: Column) -> Column:
    """The code that a keyword announces, else one alone in brackets, else null."""
    found = (F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (f"(?i){X.CODE}", X.BARE_CODE))
    return F.coalesce(*found)


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "<[^>]+>", ""))


def csv_safe(text: Column) -> Column:
    """Texts that a spreadsheet would take for a formula, with a quote before them."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def csv_plain(text: Column) -> Column:
    """The inverse of csv_safe."""
    return F.when(text.rlike(r"^'[=+\-@\t\r]"), F.substr(text, F.lit(2))).otherwise(text)


def clean_note(note: Column, asked: Column) -> Column:
    """A note without the query that it echoes at its start, if the query comes again; 300 characters at most."""
    rest = F.ltrim(F.substr(note, F.length(asked) + 1))
    echoed = note.startswith(asked) & F.contains(rest, asked)
    return F.substr(F.when(echoed, rest).otherwise(note), F.lit(1), F.lit(300))


def _any(words: list[str], latin: bool = False) -> str:
    """A regex for any of words, the longest first; Latin ones only where no letter stands before them."""
    found = f"(?:{'|'.join(sorted(words, key=len, reverse=True))})"
    return f"(?<![a-z]){found}" if latin else found


#: Words before a link that don't say what it leads to, codes with what announces them first.
FILLER = "|".join(
    [rf"(?:{_any(X.CODE_WORDS)}|{_any(X.CODE_WORDS_LATIN, True)})\s*[:：=]?\s*[a-z0-9]{{4,6}}(?![a-z0-9])", _any(X.FILLER_WORDS), f"{_any(X.FILLER_WORDS_LATIN, True)}(?![a-z])"]
)


def is_filler(segment: Column) -> Column:
    """Whether a title segment holds only codes, provider words and signs."""
    left = F.regexp_replace(F.regexp_replace(evidence(folded(segment)), FILLER, " "), r"[^\p{L}]+", "")
    return F.length(left) < 2


def verticals(text: Column, most: int = 3) -> Column:
    """The verticals that a text speaks of, the likeliest first: each keyword that it contains counts 1 and a tenth for each of
    its characters; ties go by name."""

    def scored(x: Column) -> Column:
        low, other, scores = x["low"], x["other"], []
        for name, words in X.VERTICALS.items():
            total = F.lit(0.0)
            for w in sorted(set(words)):
                where = low if any(map(str.isascii, w)) else other
                total = total + F.when(F.contains(where, F.lit(w)), 1 + len(w) / 10).otherwise(0.0)
            scores.append(F.struct((-F.round(total, 4)).alias("worse"), F.lit(name).alias("name")))
        return F.transform(F.slice(F.sort_array(F.filter(F.array(*scores), lambda s: s["worse"] < 0)), 1, most), lambda s: s["name"])

    # Keywords without ASCII characters are looked for in what is left of a text without its ASCII runs: most texts are ASCII.
    both = F.transform(F.array(F.lower(text)), lambda low: F.struct(low.alias("low"), F.regexp_replace(low, r"[\x00-\x7F]++", " ").alias("other")))
    return F.get(F.transform(both, scored), F.lit(0))
