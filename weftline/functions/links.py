"""Share links and their access codes in free text.

``share_links`` is the whole extraction, in Arrow batches of Python: it needs positions. ``plain_links`` finds only the
links with a scheme, in the JVM.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .. import fixed as X

LINK = re.compile(rf"https?://[^{X.LINK_STOP}]+")
MAGNET = re.compile(X.MAGNET, re.I)
_HOSTS = "|".join(re.escape(h) for h, _ in X.PROVIDERS if not h.endswith("."))
BARE = re.compile(rf"(?<![{X.NOT_BEFORE_BARE}])(?:{_HOSTS})/[^{X.LINK_STOP}]+", re.I)
#: Everything of interest in a text, found in one pass: links of three kinds, codes of two.
TOKEN = re.compile(rf"(?P<link>{LINK.pattern})|(?P<magnet>(?i:{X.MAGNET}))|(?P<bare>(?i:{BARE.pattern}))|(?i:{X.CODE})(?!://)|{X.BARE_CODE}")
#: A code in the query of a URL, which LINK leaves out.
QUERY_CODE = re.compile(r"\?(?:[^\s\"'<>#]*[&;])?(?:pwd|password|passwd)=([A-Za-z0-9]{4})\b")
OWN_CODE = re.compile(r"[?&#](?:pwd|password|passwd)=([A-Za-z0-9]{4})\b")
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", re.I)
SCHEMA = ArrayType(StructType([StructField("pos", IntegerType()), *(StructField(c, StringType()) for c in ("url", "pan_type", "pwd"))]))


def provider_of(url: str) -> str:
    if url.startswith("magnet:"):
        return "magnet"
    found = _HOST.match(url)
    name = "." + found[1].lower() if found else ""
    for rule, kind in X.PROVIDERS if found else ():
        if f".{rule}" in name if rule.endswith(".") else name.endswith("." + rule):
            return kind
    return "other"


def is_share(kind: str, url: str) -> bool:
    path, _, query = url.partition("#")[0].partition("?")
    path = "/" + path.split("://", 1)[-1].partition("/")[2]
    if kind == "baidu":
        return bool(re.search(r"/s/[A-Za-z0-9_-]+", path)) or "surl=" in query
    if kind not in X.SHARE_PROVIDERS:
        return kind != "other"
    return bool(re.match(r"/(s|t|share)(/|$)", path)) or "share" in path.lower() or bool(re.search(r"(?:^|&)(surl|shareid|sharelink)=", query))


def nearest_codes(links: list[tuple[int, int]], codes: list[int], window: int = X.CODE_WINDOW, left: int = X.LEFT_PENALTY) -> dict[int, int]:
    """link -> code, links and codes in the order of the text: each code goes to the nearest link that has none yet, nearest
    pairs first; codes before a link count as farther. A code looks only at links within the window."""
    starts, ends = [a for a, _ in links], [b for _, b in links]
    pairs = []
    for c, at in enumerate(codes):
        pairs += [(at - ends[k], c, k) for k in range(bisect_left(ends, at - window), bisect_right(ends, at))]
        pairs += [(starts[k] - at + left, c, k) for k in range(bisect_right(starts, at), bisect_right(starts, at + window - left))]
    given: dict[int, int] = {}
    used: set[int] = set()
    for _, c, k in sorted(pairs):
        if k not in given and c not in used:
            given[k] = c
            used.add(c)
    return given


def find(text: str | None) -> list[dict]:
    """The distinct share links of a text in order, each with its code: of the URL itself, else the nearest in the text."""
    shares: list[tuple[int, int, str, str]] = []
    codes: list[tuple[int, str]] = []
    for token in TOKEN.finditer(text or ""):
        code = token[4] or token[5]
        if code:
            codes.append((token.start(), code))
            continue
        url = html.unescape(("https://" if token["bare"] else "") + token[0].rstrip(X.LINK_TAIL))
        kind = provider_of(url)
        if is_share(kind, url):
            shares.append((*token.span(), url, kind))
    own = [m and m[1] for m in (OWN_CODE.search(url) for _, _, url, _ in shares)]
    asking = [k for k, code in enumerate(own) if not code]
    for at, c in nearest_codes([shares[k][:2] for k in asking], [at for at, _ in codes]).items():
        own[asking[at]] = codes[c][1]
    rows: dict[str, dict] = {}
    for (start, _, url, kind), code in zip(shares, own):
        row = rows.setdefault(url, {"pos": start, "url": url, "pan_type": kind, "pwd": code})
        row["pwd"] = row["pwd"] or code
    return list(rows.values())


def single_link(token: str | None) -> dict | None:
    """A lone link as it was pasted, its query kept, where ``find`` has none: of a known provider, and a share by its path or query."""
    url = html.unescape((token or "").strip().strip("<>\"'").rstrip(X.LINK_TAIL))
    if not url or re.search(r"\s", url):
        return None
    url = url if "://" in url or url.startswith("magnet:") else f"https://{url}"
    kind, code = provider_of(url), OWN_CODE.search(url)
    return {"pos": 0, "url": url, "pan_type": kind, "pwd": code[1] if code else None} if is_share(kind, url) else None


def find_or_single(text: str | None) -> list[dict]:
    return find(text) or [row for row in [single_link(text)] if row]


def find_any(markup: str | None) -> list[dict]:
    """The distinct links to known providers anywhere in a piece of HTML, attributes too, each with the code of its URL."""
    out: dict[str, dict] = {}
    for m in LINK.finditer(markup or ""):
        url = html.unescape(m[0]).rstrip(X.LINK_TAIL)
        own = OWN_CODE.search(url) or QUERY_CODE.match(markup, m.end())
        kind = provider_of(url)
        if kind != "other":
            out.setdefault(url, {"pos": m.start(), "url": url, "pan_type": kind, "pwd": own[1] if own else None})
    return list(out.values())


def titles_before(text: str | None, urls: list[str]) -> list[str | None]:
    """For each URL the text between the link before it and itself; null where that is empty or the URL isn't found."""
    at = {r["url"]: r["pos"] for r in find(text)}
    spans = sorted(m.span() for p in (LINK, MAGNET, BARE) for m in p.finditer(text or ""))
    starts, ends = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))
    out = []
    for url in urls:
        before = bisect_left(starts, at[url]) if url in at else None
        out.append(None if before is None else text[ends[before - 1] if before else 0 : at[url]].strip(X.TITLE_ENDS) or None)
    return out


@F.pandas_udf(ArrayType(StringType()))
def link_titles(texts: pd.Series, urls: pd.Series) -> pd.Series:
    return pd.Series([None if u is None else titles_before(t, list(u)) for t, u in zip(texts, urls)], dtype=object)


@F.pandas_udf(SCHEMA)
def share_links(texts: pd.Series) -> pd.Series:
    return texts.map(find)


@F.pandas_udf(SCHEMA)
def pasted_links(texts: pd.Series) -> pd.Series:
    """``share_links``; where there are none, the text itself if it is a lone link."""
    return texts.map(find_or_single)


def plain_links(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"https?://[^\s\"'<>()\[\]{}|\\^`?:,;！？，。、；：（）【】\u3000-\u9fff]+"), F.lit(0)))
