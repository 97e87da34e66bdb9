"""URL filters by a temporal list join.

Dated list entries (add or remove a host, a domain or a path prefix) become validity intervals per list and key. Every
capture is then joined, as of its fetch time, with the entries active at that time: a capture asks under its host,
its parent domains and its path prefixes.

Entries and captures are brought to one form. A scheme (`http://`, or `//` alone), user info, a fragment, empty path steps and a dot at the end of a host say nothing; the
host is in lower case; path steps compare percent-decoded unless that would make another path of them. An entry with a port holds for captures of that port
only (80 and 443 are the ports of http and https that name none), one without for all. An entry with a query holds for captures of just
that path and query, one without for every path it is a prefix of, step by step.

The as-of step is a merge by time: questions meet the key's marks (a day and whether the list then adds or removes it) in one order, and the last mark before
a question answers it. So a capture costs a row for each list its keys are on, however many intervals these have. A key that many captures ask under is
dealt to as many tasks as it needs (PER_TASK), its marks with it.

Defined results: on a day with both, add wins; an interval runs from its day to the day before the next
entry; a null or empty url, or a null time, matches nothing; a null or repeated id is answered by its own row's url and day;
null keys, days and actions are no entries, nor are keys without a host; repeated captures each give a row; repeated entries count once; empty tables
block nothing. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_TASK = 1_000_000
FOREVER = 2**31 - 1

_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*://"
_AUTHORITY = r"^(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)(?::([0-9]*))?"
#: The ports of schemes that name none.
PORTS = {"http": "80", "https": "443"}


def _parts(url: Column, scheme_needed: bool) -> tuple[Column, Column, Column, Column]:
    """(host, port or null, steps, query or null) of a url or an entry."""
    rest = F.regexp_replace(url, _SCHEME, "")
    rest = F.regexp_replace(rest, "^//", "") if not scheme_needed else rest
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, _AUTHORITY, 1)), r"\.+$", "")
    if scheme_needed:
        host = F.when(url.rlike(_SCHEME), host).otherwise("")
    port = F.nullif(F.regexp_extract(rest, _AUTHORITY, 2), F.lit(""))
    after = F.regexp_extract(F.regexp_replace(rest, "(?s)#.*$", ""), r"(?s)^[^/?]*(.*)$", 1)
    path, query = F.regexp_extract(after, r"(?s)^([^?]*)", 1), F.regexp_extract(after, r"(?s)^[^?]*\?(.*)$", 1)
    plain = lambda x: F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))
    steps = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.when(F.coalesce(plain(x).rlike("(?s)^[^/?#%]+$"), F.lit(False)), plain(x)).otherwise(x))
    return host, port, steps, F.when(F.contains(after, F.lit("?")), query)


def _key(host: Column, port: Column | None, steps: Column, query: Column | None = None) -> Column:
    own = host if port is None else F.concat(host, F.lit(":"), port)
    own = F.when(F.size(steps) > 0, F.concat(own, F.lit("/"), F.array_join(steps, "/"))).otherwise(own)
    return own if query is None else F.concat(own, F.lit("?"), query)


def entry_key(key: Column) -> Column:
    """An entry's key as keys_of states it; null for one without a host."""
    host, port, steps, query = _parts(F.trim(key), False)
    named = F.when(port.isNull(), _key(host, None, steps)).otherwise(_key(host, port, steps))
    return F.when(host != "", F.when(query.isNull(), named).otherwise(F.concat(named, F.lit("?"), query)))


def keys_of(url: Column) -> Column:
    """What a capture asks under, each without and with its port: host, parent domains of two labels or more, host with each path prefix, and host with whole path and query."""
    host, port, steps, query = _parts(url, True)
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    port = F.coalesce(port, *[F.when(scheme == s, p) for s, p in PORTS.items()])
    none, numeric = F.array().cast("array<string>"), host.startswith("[") | host.rlike(r"^[0-9.]+$")
    labels = F.split(host, r"\.")
    parents = F.when(numeric, F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    paths = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(steps))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")))).otherwise(none)
    whole = F.when(query.isNotNull(), F.array(F.concat(F.when(F.size(steps) > 0, F.concat(F.lit("/"), F.array_join(steps, "/"))).otherwise(""), F.lit("?"), query))).otherwise(none)
    below = F.concat(paths, whole)
    at = lambda suffix: F.concat(F.transform(parents, lambda h: F.concat(h, suffix)), F.transform(below, lambda p: F.concat(host, suffix, p)))
    keys = F.concat(at(F.lit("")), F.when(port.isNotNull(), at(F.concat(F.lit(":"), port))).otherwise(none))
    return F.when(host != "", F.array_distinct(keys)).otherwise(none)


def marks(entries: DataFrame) -> DataFrame:
    """entries(list, key, day, action) as (list, key, day, adds): what holds for a list and key from a day on."""
    entries = entries.where(F.col("list").isNotNull() & F.col("day").isNotNull() & F.col("action").isin("add", "remove"))
    keyed = entries.select("list", entry_key(F.col("key")).alias("key"), "day", "action").where("key IS NOT NULL")
    return keyed.groupBy("list", "key", "day").agg(F.max(F.col("action") == "add").alias("adds"))


def intervals(entries: DataFrame) -> DataFrame:
    """entries(list, key, day, action) as (list, key, since, until): active from since to until, the latter excluded."""
    order = Window.partitionBy("list", "key").orderBy("day")
    closed = marks(entries).withColumn("until", F.coalesce(F.lead("day").over(order), F.lit(FOREVER)))
    return closed.where("adds").select("list", "key", F.col("day").alias("since"), "until")


def evaluate(captures: DataFrame, entries: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """captures(id, url, day) with blocked, n_active (entries active for it) and lists (their names, sorted, joined by a comma).

    The answer hangs on url and day alone, so each (url, day) asks once, whatever ids it bears and however often it repeats."""
    given = marks(entries)
    once = captures.where(F.col("url").isNotNull() & F.col("day").isNotNull()).select("url", "day").distinct()
    asked = once.select("url", "day", F.explode(keys_of(F.col("url"))).alias("key"))
    on = given.groupBy("key").agg(F.collect_set("list").alias("lists"))
    # how many tasks a key's questions need
    often = asked.groupBy("key").agg(F.count("*").alias("n"))
    known = on.join(often, "key").select("key", "lists", F.ceil(F.col("n") / per_task).cast("int").alias("salts"))
    questions = asked.join(known, "key").select("key", F.explode("lists").alias("list"), F.pmod(F.xxhash64("url", "day"), F.col("salts")).cast("int").alias("salt"), "day", "url")
    dealt = given.join(known.select("key", "salts"), "key").select("key", "list", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "day", "adds")
    both = questions.withColumn("adds", F.lit(None).cast("boolean")).unionByName(dealt.withColumn("url", F.lit(None).cast("string")))
    # marks of a day come before its questions: their url is null
    state = F.last("adds", ignorenulls=True).over(Window.partitionBy("key", "list", "salt").orderBy("day", F.asc_nulls_first("url")).rowsBetween(Window.unboundedPreceding, 0))
    hits = both.withColumn("active", state).where("url IS NOT NULL AND active")
    found = hits.groupBy("url", "day").agg(F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"))
    out = captures.select("id", "url", "day").join(found, ["url", "day"], "left")
    return out.select("id", "url", "day", F.col("n_active").isNotNull().alias("blocked"), F.coalesce("n_active", F.lit(0)).alias("n_active"), F.coalesce("lists", F.lit("")).alias("lists"))
