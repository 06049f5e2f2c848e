"""URL filters: host and path rules, then logistic regression on hashed character n-grams. DataFrame functions only.

The model is trained on the driver from a small labelled table of URLs; its features come from the same column
expressions that score, so training and scoring hash alike.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower

#: Buckets of the hashed n-grams, and the lengths of these.
BUCKETS = 16384
LENGTHS = (3, 4)
#: (rule, verdict), rule being host/path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Rows of the labelled table of each class.
TABLE_ROWS = 600
#: What the labelled table is made of: parts of site names by class, subdomains, top levels, and paths by class.
GOOD_NAMES = """library museum garden weather railway harbour recipe kitchen cycling science history theatre hospital school university painter
chemistry parliament radio archive village mountain river coffee bakery cinema orchestra poetry novel atlas planet telescope insect bird forest
farmhouse bookshop teacher engineer carpenter physics geology language grammar dictionary newspaper gazette tribune chronicle economy council
climate energy housing transport nursing medicine dentist pharmacy veterinary sailing climbing running football chess piano guitar knitting
pottery photography camera drawing software compiler database network protocol kernel tutorial handbook forum wiki notes journal letters""".split()
BAD_NAMES = """casino poker slots roulette betting bets jackpot lottery adult porn xxx cams escort dating pills viagra pharma steroid loans payday
credit crypto giveaway airdrop replica watches crack keygen warez spam seo backlinks linkfarm followers likes prize sweepstake freebie
clickbait traffic popup toolbar malware phishing ads adserver track tracker banner doorway""".split()
BAD_HINTS = "free cheap best hot win fast easy buy online bonus farm club vip x money".split()
#: Syllables of invented names: most sites' names are no words.
SYLLABLES = "an ber con den er fin gar hal ing jor kel lin mon nor on per quin ren ston ther tion ul ver wen ly ble sh nd".split()
SUBDOMAINS = ("", "www.", "blog.", "m.", "shop.", "news.", "en.", "forum.")
GOOD_ENDS = ("com", "org", "net", "edu", "de", "fr", "co.uk", "info", "dev", "example.com", "example.org", "example.net")
BAD_ENDS = ("com", "biz", "net", "win", "click", "info", "top", "org", "xyz", "example.com", "example.org", "example.net")
GOOD_PATHS = ("/en/{0}", "/fr/{0}.html", "/de/{0}/", "/es/{0}", "/article/{0}", "/news/2021/{0}", "/wiki/topic_{0}", "/", "/guide/install.html", "/thread/{0}?page=2", "/en/{0}#top", "/about")
BAD_PATHS = ("/en/{0}", "/fr/{0}.html", "/de/{0}/", "/es/{0}", "/play/now", "/buy?id={0}", "/claim/bonus", "/", "/signup/free", "/en/{0}?utm_source=feed", "/go/{0}", "/offer/{0}")


def labelled_urls(rows: int = TABLE_ROWS) -> tuple[list[str], list[str]]:
    """The labelled table: URLs to keep and URLs to block, ``rows`` of each, by a fixed rule over the parts above.

    Names, ends and paths are taken in steps without a common divisor with their number, so each meets many others.
    """
    good, bad = [], []
    for k in range(rows):
        number = 7 + 131 * k % 9973
        two = GOOD_NAMES[(7 * k + 3 + k // len(GOOD_NAMES)) % len(GOOD_NAMES)]
        made = "".join(SYLLABLES[(k * step + k // step) % len(SYLLABLES)] for step in (3, 5, 11))
        name = (GOOD_NAMES[k % len(GOOD_NAMES)] + ("", two, "-" + two)[k // 2 % 3], made)[k % 2]
        good.append(f"https://{SUBDOMAINS[5 * k % 8]}{name}.{GOOD_ENDS[(7 * k + k // 12) % 12]}{GOOD_PATHS[(5 * k + k // 7) % 12].format(number)}")
        hint, word = BAD_HINTS[(4 * k + k // 15) % len(BAD_HINTS)], BAD_NAMES[k % len(BAD_NAMES)]
        name = (f"{word}-{hint}", f"{hint}-{word}", f"{word}{hint}", f"{hint}{word}")[(k + k // len(BAD_NAMES)) % 4]
        bad.append(f"http://{SUBDOMAINS[3 * k % 8]}{name}.{BAD_ENDS[(5 * k + k // 12) % 12]}{BAD_PATHS[(7 * k + k // 7) % 12].format(number)}")
    return good, bad


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path. Host: after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path: then up to ``? #``. Null or no ``://``: empty."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. A rule fits its host and all subdomains, if the path starts with the rule's."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(reversed(rules), key=lambda r: len(r[0])):
        own, slash, under = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + under)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams(host: Column, path: Column) -> Column:
    """Hash buckets of the character n-grams of host and path, as an array."""

    def of(text: Column, salt: int, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.pmod(F.xxhash64(F.lit(salt), F.substr(text, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))

    return F.concat(*(of(F.concat(F.lit("^"), text, F.lit("$")), salt, n) for salt, text in ((1, host), (2, path)) for n in LENGTHS))


def train(spark: SparkSession, good: Sequence[str] | None = None, bad: Sequence[str] | None = None, rounds: int = 20, rate: float = 0.5, ridge: float = 1e-3) -> list[float]:
    """Weights of the buckets, the last the bias, by stochastic gradient steps over the labelled table, in a fixed order.

    Without URLs of its own it learns from ``labelled_urls``, which doesn't grow with the pages.
    """
    if good is None or bad is None:
        good, bad = labelled_urls()
    table = spark.createDataFrame([(k, u, y) for k, (u, y) in enumerate([*((u, 0) for u in good), *((u, 1) for u in bad)])], "k int, url string, y int")
    host, path = url_parts(F.col("url"))
    rows = [(r["y"], sorted(set(r["g"]))) for r in table.select("k", "y", host.alias("h"), path.alias("p")).select("k", "y", grams(F.col("h"), F.col("p")).alias("g")).orderBy("k").collect()]
    half = len(good)
    order = [x for pair in zip(rows[:half], (rows[half:] * (half // max(1, len(rows) - half) + 1))[:half]) for x in pair]
    w = [0.0] * (BUCKETS + 1)
    for r in range(rounds):
        step = rate / (1 + 0.1 * r)
        for y, features in order:
            scale = 1 / math.sqrt(len(features))
            z = w[BUCKETS] + scale * sum(w[f] for f in features)
            slope = 1 / (1 + math.exp(-z)) - y
            for f in features:
                w[f] -= step * (slope * scale + ridge * w[f])
            w[BUCKETS] -= step * 0.1 * slope
    return w


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, weights: list[float] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row; the score is the model's likelihood of ``block``.

    The longest rule that fits decides (of equally long ones the first of ``rules``), else the model: a score over 0.5 is
    ``block``, one of exactly 0.5 ``allow``. A null URL or one without ``://`` has an empty host and path and is scored as
    such. URLs of any length are scored whole. An empty table gives an empty result; repeated rows are judged each; other
    columns are ignored, whatever their names.
    """
    w = weights or train(pages.sparkSession)
    literal = F.lit(",".join(f"{x:.9g}" for x in w[:BUCKETS]))
    table = F.split(literal, ",").cast("array<double>")
    host, path = url_parts(F.col("url"))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    features = parts.withColumn("grams", F.array_distinct(grams(F.col("host"), F.col("path"))))
    total = F.aggregate("grams", F.lit(0.0), lambda a, g: a + F.get(table, g)) / F.sqrt(F.greatest(F.size("grams"), F.lit(1))) + F.lit(float(w[BUCKETS]))
    scored = features.withColumn("score", 1 / (1 + F.exp(-total))).withColumn("match", matching_rule(F.col("host"), F.col("path"), rules))
    judged = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("match.rule").alias("rule"), F.coalesce(F.col("match.verdict"), judged).alias("verdict"), "score")

