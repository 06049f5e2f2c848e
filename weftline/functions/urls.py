"""URLs as columns: parts, provider, share token, access code, canonical form and the key that a share is grouped by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import CONTENT_HOSTS, NOISE_HOSTS, PROVIDERS, SHARE_PROVIDERS, STATIC_ENDINGS

#: scheme, authority, path, query, fragment; never fails, whatever the text.
PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, PARTS, k)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def path(url: Column) -> Column:
    return part(url, 3)


def query(url: Column) -> Column:
    return part(url, 4)


def fragment(url: Column) -> Column:
    return part(url, 5)


def host(url: Column) -> Column:
    """Lower-cased host without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def provider(url: Column) -> Column:
    """The provider that the host falls under: a rule's host or a subdomain of it. One expression, no join.

    Rules of one provider make one pattern; the host is bound once.
    """
    ends: dict[str, list[str]] = {}
    for rule, name in PROVIDERS:
        ends.setdefault(name, []).append(rule.replace(".", r"\.") + ("" if rule.endswith(".") else "$"))

    def told(name: Column) -> Column:
        rest = F.lit("other")
        for kind in reversed(ends):
            rest = F.when(name.rlike(rf"(?:^|\.)(?:{'|'.join(ends[kind])})"), kind).otherwise(rest)
        return F.when(name == "", "other").otherwise(rest)

    return F.when(url.startswith("magnet:"), "magnet").otherwise(F.get(F.transform(F.array(host(url)), told), F.lit(0)))


def query_value(url: Column, names: str) -> Column:
    """The first value of a query parameter; ``names`` is a regex alternation. Null if there is none."""
    return F.nullif(F.regexp_extract(query(url), rf"(?:^|&)(?:{names})=([^&]+)", 1), F.lit(""))


def looks_like_share(kind: Column, url: Column) -> Column:
    p = path(url)
    entry = p.rlike(r"^/(s|t|share)(/|$)") | F.contains(F.lower(p), F.lit("share")) | query_value(url, "surl|shareid|sharelink").isNotNull()
    return ~kind.isin(SHARE_PROVIDERS) | entry


def code_in_url(url: Column) -> Column:
    """The access code that a URL carries as a parameter or a fragment of four characters; else null."""
    direct = F.regexp_extract(url, r"(?i)[?&#](?:pwd|password|passwd)=?([A-Za-z0-9]{4})\b", 1)
    tail = F.regexp_extract(fragment(url), r"^([A-Za-z0-9]{4})$", 1)
    named = F.regexp_extract(query(url), r"(?:^|&)(?:pwd|password|passwd|code)=([A-Za-z0-9]{4})(?:&|$)", 1)
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in (direct, tail, named)))


def unquote(url: Column) -> Column:
    """Percent-decoding that leaves plus signs; what can't be decoded stays."""
    return F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)


def share_token(url: Column) -> Column:
    """The token of a share on the provider with tokens of its own, plain or percent-encoded; else null."""
    plain = F.regexp_extract(unquote(url), r"(?i)pan\.baidu\.com/s/([A-Za-z0-9_-]+)", 1)
    return F.coalesce(F.nullif(plain, F.lit("")), query_value(unquote(url), "surl"))


def strip_leading_one(token: Column) -> Column:
    return F.when(token.startswith("1") & (F.length(token) > 1), F.substr(token, F.lit(2))).otherwise(token)


def without_display_name(url: Column) -> Column:
    """A magnet link without its dn parameters; trackers stay, in order."""
    cut = F.locate("?", url)
    kept = F.filter(F.split(F.substr(url, cut + 1), "&"), lambda p: (p != "") & ~F.lower(p).startswith("dn="))
    head = F.substr(url, F.lit(1), cut - 1)
    return F.when(cut == 0, url).when(F.size(kept) > 0, F.concat(head, F.lit("?"), F.array_join(kept, "&"))).otherwise(head)


def canonical(kind: Column, url: Column, token: Column) -> Column:
    shown = F.concat(part(url, 1), F.lit("://"), part(url, 2), path(url))
    whole = (part(url, 1) != "") & (part(url, 2) != "")
    return (
        F.when((kind == "baidu") & token.isNotNull(), F.concat(F.lit("https://pan.baidu.com/s/"), token))
        .when(kind == "magnet", without_display_name(url))
        .otherwise(F.when(whole, shown).otherwise(url))
    )


def resource_key(kind: Column, url: Column, token: Column) -> Column:
    """What the hits of one share have in common."""
    info = F.regexp_extract(url, r"btih:([A-Za-z0-9]+)", 1)
    own = F.rtrim(path(url), F.lit("/"))
    return (
        F.when((kind == "baidu") & token.isNotNull(), F.concat(F.lit("baidu:"), token))
        .when(kind == "magnet", F.concat(F.lit("magnet:"), F.when(info != "", F.lower(info)).otherwise(url)))
        .otherwise(F.concat(kind, F.lit(":"), F.when(own != "", F.concat(host(url), own)).otherwise(url)))
    )


def path_id(url: Column) -> Column:
    """The segment after /s/ or /t/, else the last of the path."""
    marked = F.regexp_extract(path(url), r"/[st]/([^/]+)", 1)
    last = F.element_at(F.split(F.rtrim(path(url), F.lit("/")), "/"), -1)
    return F.coalesce(F.nullif(marked, F.lit("")), last)


def magnet_name(url: Column) -> Column:
    """The display name of a magnet link, decoded up to twice; else null."""
    raw = F.nullif(F.regexp_extract(url, r"[?&]dn=([^&]*)", 1), F.lit(""))
    once = F.coalesce(F.try_url_decode(raw), raw)
    return F.coalesce(F.try_url_decode(once), once)


def rebuild(key: Column) -> Column:
    """A URL that has this key."""
    kind, rest = F.substring_index(key, ":", 1), F.regexp_extract(key, r"(?s)^[^:]*:(.*)$", 1)
    return F.when(kind == "baidu", F.concat(F.lit("https://pan.baidu.com/s/"), rest)).when(kind == "magnet", F.concat(F.lit("magnet:?xt=urn:btih:"), rest)).otherwise(F.concat(F.lit("https://"), rest))


def with_code(kind: Column, url: Column, code: Column) -> Column:
    """A link that opens without asking for the code, where the provider takes it in the URL."""
    return F.when((kind == "baidu") & code.isNotNull(), F.concat(url, F.lit("?pwd="), code)).otherwise(url)


def expand_template(template: Column, term: Column) -> Column:
    """{q} replaced by the percent-encoded term; spaces as %20, slashes kept."""
    quoted = F.replace(F.replace(F.url_encode(term), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    return F.replace(template, F.lit("{q}"), quoted)


#: Characters that stand for a run of digits, and a word, while a path is turned into its shape.
DIGITS, WORD = "\x01", "\x02"


def path_shape(p: Column) -> Column:
    """A path as a regex for its like: digits, words and the file extension generalised; null if nothing is."""
    low = F.regexp_extract(F.lower(p), r"^([^?#]*)", 1)
    ext = F.regexp_extract(low, r"\.(?:html?|php|aspx?|jsp)$", 0)
    body = F.substr(low, F.lit(1), F.length(low) - F.length(ext))
    marked = F.regexp_replace(F.regexp_replace(body, r"[a-z][a-z0-9_-]*", WORD), r"[0-9]+", DIGITS)
    escaped = F.regexp_replace(marked, r"([.^$*+?{}\[\]|()&~#\- ])", r"\\$1")
    shape = F.replace(F.replace(escaped, F.lit(DIGITS), F.lit(r"\d+")), F.lit(WORD), F.lit("[a-z0-9_-]+"))
    dull = ~marked.rlike(f"[{DIGITS}{WORD}]") | F.contains(marked, F.lit("%"))
    return F.when(~dull, F.concat(shape, F.replace(ext, F.lit("."), F.lit(r"\."))))


def detail_likeness(shape: Column) -> Column:
    """How much a shape looks like a content page's: extension 3, underscore 2, digits 1, depth 1."""
    has = lambda text: F.contains(shape, F.lit(text)).cast("int")
    deep = (F.length(shape) - F.length(F.replace(shape, F.lit("/"))) >= 4).cast("int")
    return 3 * F.greatest(has(".html"), has(".htm"), has(".php")) + 2 * has("_") + has(r"\d") + deep


def is_chinese_site(name: Column) -> Column:
    """Whether a host is under a top-level domain that Chinese sites use."""
    return name.rlike(r"\.(?:cn|cc|me|top|xyz)$")


def is_noise(name: Column, hosts: list[str], but: list[str] = []) -> Column:
    """Whether a host is one of a list or under it; an entry that ends in a dot, or has none, is looked for anywhere."""
    out = F.lit(False)
    for h in hosts:
        anywhere = h.endswith(".") or "." not in h
        out = out | (F.contains(name, F.lit(h)) if anywhere else (name == h) | name.endswith("." + h))
    return out & ~name.isin(but) if but else out


def worth_reading(url: Column) -> Column:
    """Whether a result of a search engine may be a page of contents: no engine, CDN or counter, no static file, no home page,
    and no share itself."""
    own, place = host(url), F.lower(path(url))
    content = F.exists(F.array(*map(F.lit, CONTENT_HOSTS)), lambda h: (own == h) | own.endswith(F.concat(F.lit("."), h)))
    static = F.exists(F.array(*map(F.lit, STATIC_ENDINGS)), lambda e: place.endswith(e))
    return (own != "") & scheme(url).isin("http", "https") & (content | ~is_noise(own, NOISE_HOSTS)) & ~static & ~F.contains(own, F.lit("pan.baidu.com")) & (F.regexp_replace(place, "/", "") != "")
