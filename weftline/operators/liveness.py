"""Liveness: cached states with a time to live, decisions over captured answers, budgets, pruning, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed as X


#: Rules of answers that are broadcast at most.
RULE_ROWS = 10_000


def status_table(spark) -> DataFrame:
    return spark.createDataFrame(X.STATUSES, "status string, weight double, tier int, bucket string, is_alive boolean, is_dead boolean")


def is_dead(status: Column) -> Column:
    return status.isin([s[0] for s in X.STATUSES if s[5]])


def latest(rows: DataFrame, keys: list[str], *by: str) -> DataFrame:
    """The last version of every key: one aggregation, no sort."""
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("row"))
    return newest.select(*keys, "row.*")


def valid(status: Column, checked_at: Column, now: Column, ttl_hours: float = X.TTL_HOURS, dead_hours: float = X.DEAD_TTL_HOURS) -> Column:
    """Whether a cached state still holds; a time to live of zero or less never ends."""
    age = F.unix_timestamp(now) - F.unix_timestamp(checked_at)

    def within(hours: float) -> Column:
        return F.lit(True) if hours <= 0 else age <= hours * 3600

    return F.when(is_dead(status), within(dead_hours)).otherwise(within(ttl_hours))


def annotate(resources: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Resources with the cached status of (key, pwd) where it still holds, else ``unchecked``: one row for each.

    Of several cached rows of a key the one that was checked last counts (of these, that of the largest event_id, if the
    cache has one).
    """
    by = ["checked_at", *(c for c in ("event_id",) if c in cache.columns)]
    last = latest(cache.select("cache_key", "pwd", "status", "pwd_verified", "title_hint", *by), ["cache_key", "pwd"], *by)
    fresh = last.filter(valid(F.col("status"), F.col("checked_at"), now)).select(F.col("cache_key").alias("k"), F.col("pwd").alias("p"), "status", "pwd_verified", "title_hint")
    out = resources.join(fresh, (F.col("key") == F.col("k")) & F.col("pwd").eqNullSafe(F.col("p")), "left").drop("k", "p")
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("title_hint"))
    return out.withColumn("title", title).withColumn("status", F.coalesce("status", F.lit("unchecked"))).withColumn("pwd_verified", F.coalesce("pwd_verified", F.lit(False))).drop("title_hint")


#: Rules of answers: endpoint, place (the first that holds counts), field (a JSON path, ``http``, ``body``, or a tag of XML),
#: test, value, status.
RULES = "endpoint string, place int, field string, test string, value string, status string"


def default_rules(direct: str = "alive") -> list[tuple]:
    """The rules of the known endpoints. Direct links have nothing to ask: ``direct`` says what they are."""
    exact = lambda field, codes: [(field, "is", code, status) for code, status in codes.items()]
    otherwise = [("body", "any", None, "unknown")]
    by = {
        "baidu_liveness": exact("$.errno", X.BAIDU_LIVENESS) + otherwise,
        "baidu_code": exact("$.errno", X.BAIDU_CODE) + otherwise,
        "quark": [("http", "is", "404", "not_found"), *exact("$.code", X.QUARK_CODE), ("$.status", "is", "200", "alive"), *otherwise],
        "aliyun": [
            *exact("$.code", X.ALIYUN_CODE), *(("$.code", "has", text, status) for text, status in X.ALIYUN_CONTAINS.items()),
            ("http", "is", "404", "not_found"), ("http", "not", "200", "unknown"), ("$.expiration", "past", None, "dead"), ("body", "any", None, "alive"),
        ],
        "115": [*exact("$.errno", X.P115_CODE), ("$.state", "is", "false", "not_found"), ("$.state", "is", "true", "alive"), *otherwise],
        "tianyi": [("body", "has", "<shareVO>", "alive"), *exact("code", X.TIANYI_XML), ("http", "is", "400", "not_found"), *otherwise],
        "direct": [("body", "any", None, direct)],
    }
    return [(endpoint, place, *rule) for endpoint, rules in by.items() for place, rule in enumerate(rules)]


def decide(responses: DataFrame, now: Column, direct: str = "alive", rules: DataFrame | None = None) -> DataFrame:
    """responses (key, pwd, endpoint, http_status, body) -> with status: that of the first rule of its endpoint that holds.

    Tests: ``is``, ``not`` (of what is there), ``has`` (contains), ``past`` (a time before now), ``any``. An endpoint without
    rules is unsupported, an answer that none fits unknown. Rules come to the answers as one list for each endpoint, so
    answers are neither shuffled nor multiplied. A provider is added by rows: rules, of RULES, in place of the default ones.
    """
    spark = responses.sparkSession
    table = spark.createDataFrame(default_rules(direct), RULES) if rules is None else rules
    by = table.groupBy("endpoint").agg(F.sort_array(F.collect_list(F.struct("place", "field", "test", "value", "status"))).alias("rules"))
    by = F.broadcast(by) if rules is None or rules.count() <= RULE_ROWS else by

    def holds(rule: Column) -> Column:
        field, value = rule["field"], rule["value"]
        tag = F.concat(F.lit("<"), field, F.lit(">([^<]*)</"), field, F.lit(">"))
        found = (
            F.when(field.startswith("$"), F.call_function("get_json_object", F.col("body"), field)).when(field == "http", F.col("http_status").cast("string")).when(field == "body", F.col("body"))
            .otherwise(F.nullif(F.call_function("regexp_extract", F.col("body"), tag, F.lit(1)), F.lit("")))
        )
        test = rule["test"]
        told = F.when(test == "any", True).when(test == "is", found == value).when(test == "has", F.contains(found, value)).when(test == "not", found != value).when(test == "past", F.try_to_timestamp(found) < now)
        return F.coalesce(told, F.lit(False))

    columns = responses.columns
    asked = responses.join(by, "endpoint", "left")
    status = F.when(F.col("rules").isNull(), "unsupported").otherwise(F.coalesce(F.get(F.filter("rules", holds), F.lit(0))["status"], F.lit("unknown")))
    return asked.select(*columns, status.alias("status"))


def decide_with_code(responses: DataFrame) -> DataFrame:
    """One row per (key, pwd) from decided answers: a right code settles it, a wrong one leaves alive or not to the liveness answer, else that decides."""
    by = responses.groupBy("key", "pwd").agg(
        F.max(F.when(F.col("endpoint") == "baidu_code", F.col("status"))).alias("code"), F.max(F.when(F.col("endpoint") == "baidu_liveness", F.col("status"))).alias("live")
    )
    live = F.coalesce("live", F.lit("unknown"))
    status = F.when(F.col("code").isin("alive", "not_found"), F.col("code")).when(F.col("code") == "wrong_pwd", F.when(live.isin("dead", "not_found"), live).otherwise("wrong_pwd")).otherwise(live)
    return by.select("key", "pwd", status.alias("status"), (F.coalesce(F.col("code"), F.lit("")) == "alive").alias("pwd_verified"))


def budgeted(rows: DataFrame, budget: int = X.BUDGET, early_share: float = X.EARLY_SHARE) -> DataFrame:
    """Which unchecked rows would be checked: the early ones (high relevance) may take a share of the budget, the rest what is left.

    A budget of 0 or less is none: all are checked. Two top-k's rather than a global window: the budget bounds what is ranked in one task.
    """
    if budget <= 0:
        return rows.withColumn("phase", F.when(F.col("relevance") >= X.HIGH, "early").otherwise("late"))
    early_n = int(budget * early_share)
    first = [F.desc("relevance"), F.desc("score"), F.col("first_seq")]
    early = rows.filter(F.col("relevance") >= X.HIGH).orderBy(*first).limit(early_n).select("key", F.lit("early").alias("phase"))
    late = rows.join(early, "key", "left_anti").orderBy(*first).limit(budget).select("key", "relevance", "score", "first_seq")
    left = late.crossJoin(early.agg(F.count(F.lit(1)).alias("used")))  # one row
    place = F.row_number().over(Window.orderBy(*first))  # over the budget's rows at most
    late = left.withColumn("n", place).filter(F.col("n") + F.col("used") <= budget).select("key", F.lit("late").alias("phase"))
    return rows.join(early.unionByName(late), "key", "left").withColumn("phase", F.coalesce("phase", F.lit("unchecked")))


def prune(rows: DataFrame, strict: bool = False, keep_unsupported: bool = True) -> DataFrame:
    """By default all but the dead; strict: alive and need_pwd, and what can't be checked if that is kept."""
    keep = F.col("status").isin("alive", "need_pwd") if strict else ~is_dead(F.col("status"))
    if strict and keep_unsupported:
        keep = keep | (F.col("status") == "unsupported")
    return rows.filter(keep)


def stale(cache: DataFrame, now: Column, older_hours: float, dead_hours: float, limit: int) -> DataFrame:
    """The queue for another check: oldest first; the dead only after a time of their own, within the filter so that the limit isn't wasted."""
    age = (F.unix_timestamp(now) - F.unix_timestamp("checked_at")) / 3600
    due = F.when(is_dead(F.col("status")), age >= dead_hours).otherwise(age >= older_hours)
    return cache.filter(due).withColumn("age_hours", F.round(age, 1)).orderBy("checked_at", "cache_key").limit(limit)


def failures(runs: DataFrame) -> DataFrame:
    """Per domain and run (domain, run_at, event_id, hits, error) the consecutive errors so far; a run with hits resets them."""
    w = Window.partitionBy("domain").orderBy("run_at", "event_id")
    island = runs.withColumn("island", F.sum((F.col("hits") > 0).cast("int")).over(w))
    inner = Window.partitionBy("domain", "island").orderBy("run_at", "event_id")
    return island.withColumn("fails", F.sum(F.col("error").isNotNull().cast("int") * (F.col("hits") == 0).cast("int")).over(inner)).drop("island")


def disabled(runs: DataFrame, after: int = X.DISABLE_AFTER) -> DataFrame:
    last = failures(runs).groupBy("domain").agg(F.max_by("fails", F.struct("run_at", "event_id")).alias("fails"))
    return last.filter(F.col("fails") >= after)
