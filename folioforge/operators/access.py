"""Which addresses may be read: checks of URLs, address ranges, and rules of hosts by longest prefix, all as joins and Columns."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names and addresses that are never public, and the ranges that registries keep for private, local, test, multicast
#: and future use. ``PUBLIC`` lists the exceptions within them.
PRIVATE_NAMES = ("localhost", "ip6-localhost", "broadcasthost")
METADATA = ("100.100.2.136",)
PRIVATE = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
    "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "2001::/23", "2001:db8::/32", "2002::/16", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fc00::/7", "fe00::/9", "fe80::/10", "ff00::/8",
)
PUBLIC = ("192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
MAPPED = "0" * 20 + "ffff"


def url_parts(url: Column) -> tuple[Column, Column, Column, Column]:
    """Scheme, user part with its ``@``, host without port (brackets of IPv6 literals removed), path with query; lower case but for the path."""
    whole = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::[^/?#]*)?([^#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, whole, k), F.lit(""))
    path = F.when(F.startswith(part(4), F.lit("/")), part(4)).otherwise(F.concat(F.lit("/"), part(4)))
    return F.lower(part(1)), part(2), F.regexp_replace(F.lower(part(3)), r"[\[\]]|\.$", ""), path


def address(host: Column) -> Column:
    """The 32 hex digits of an address literal, IPv4 as mapped into IPv6; null for names and malformed literals."""
    four = F.split(host, r"\.")
    number = r"(?:0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])"
    dotted = F.concat(F.lit(MAPPED), *(F.lpad(F.lower(F.hex(F.get(four, F.lit(i)).cast("int"))), 2, "0") for i in range(4)))
    tail = F.split(F.regexp_extract(host, r":([\d.]+)$", 1), r"\.")
    ends_dotted = host.rlike(rf":{number}(\.{number}){{3}}$")
    two = [F.concat(*(F.lpad(F.lower(F.hex(F.get(tail, F.lit(i + j)).cast("int"))), 2, "0") for j in (0, 1))) for i in (0, 2)]
    plain = F.when(ends_dotted, F.concat(F.regexp_extract(host, r"^(.*:)[\d.]+$", 1), two[0], F.lit(":"), two[1])).otherwise(host)
    return F.when(host.rlike(rf"^{number}(\.{number}){{3}}$"), dotted).when(F.contains(host, F.lit(":")), _once(plain, _six))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _six(plain: Column) -> Column:
    groups = lambda k: F.filter(F.split(F.split_part(plain, F.lit("::"), F.lit(k)), ":"), lambda x: x != "")
    short = F.contains(plain, F.lit("::"))
    full = lambda head, rest: F.when(short, F.concat(head, F.array_repeat(F.lit("0"), F.greatest(8 - F.size(head) - F.size(rest), F.lit(0))), rest)).otherwise(head)
    shaped = plain.rlike(r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)?$")
    least = F.when(short, F.size(groups(1)) + F.size(groups(2)) <= 7).otherwise(F.size(groups(1)) == 8)
    return F.when(shaped & least, F.array_join(F.transform(full(groups(1), groups(2)), lambda x: F.lpad(x, 4, "0")), ""))


def _range(cidr: str) -> tuple[str, str]:
    net = ipaddress.ip_network(cidr)
    ends = [format(int(x), "032x") for x in (net.network_address, net.broadcast_address)]
    return tuple(MAPPED + e[24:] if net.version == 4 else e for e in ends)


def private_host(host: Column) -> Column:
    """Whether a host is a local name or an address literal of a range that is not public. Names are not resolved."""

    def closed(at: Column) -> Column:
        within = lambda cidrs: reduce(lambda a, b: a | b, (at.between(*_range(c)) for c in cidrs))
        mapped = F.startswith(at, F.lit(MAPPED))
        return F.when(mapped, within([c for c in PRIVATE if "." in c])).otherwise(within([c for c in PRIVATE if ":" in c])) & ~within(PUBLIC)

    literal = F.coalesce(_once(address(host), closed), F.lit(False))
    return host.isin(*PRIVATE_NAMES, *METADATA) | host.endswith(".localhost") | literal


def rules_of(lines: DataFrame, agent: str) -> DataFrame:
    """``host, prefix, allow, seconds``: the rules for ``agent`` of ``host, line_no, line``, and its delay as a row without prefix.

    Of the groups of a host the first that names the agent counts, else the first for all. Comments, blank lines, unknown keys, empty values
    and rules before any agent say nothing. A host's lines are one window, as they are one file.
    """
    key, value = F.lower(F.trim(F.split_part("text", F.lit(":"), F.lit(1)))), F.trim(F.regexp_extract("text", r"^[^:]*:(.*)$", 1))
    rows = lines.withColumn("text", F.regexp_replace("line", "#.*$", "")).select("host", "line_no", key.alias("key"), value.alias("value"))
    rows = rows.where(F.col("key").isin("user-agent", "allow", "disallow", "crawl-delay"))
    order = Window.partitionBy("host").orderBy("line_no")
    opens = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")
    rows = rows.withColumn("opens", opens.cast("int")).withColumn("part", F.sum("opens").over(order)).where("part > 0")
    named = F.col("value") == "*"
    mine = (F.col("value") != "") & F.contains(F.lit(agent.lower()), F.lower("value"))
    parts = rows.where("key = 'user-agent'").groupBy("host").agg(F.coalesce(F.min(F.when(mine, F.col("part"))), F.min(F.when(named, F.col("part")))).alias("part"))
    said = rows.where("key <> 'user-agent' and value <> ''").join(parts, ["host", "part"])
    rule = said.where("key <> 'crawl-delay'").groupBy("host", F.col("value").alias("prefix")).agg(F.max(F.col("key") == "allow").alias("allow"), F.lit(None).cast("double").alias("seconds"))
    delay = said.where("key = 'crawl-delay'").groupBy("host").agg(F.max_by(F.try_to_number("value", F.lit("999999.999")).cast("double"), "line_no").alias("seconds"))
    return rule.unionByName(delay.select("host", F.lit(None).cast("string").alias("prefix"), F.lit(None).cast("boolean").alias("allow"), "seconds"))


def checked(urls: DataFrame, rules: DataFrame, status: DataFrame, allowed: DataFrame | None = None, key: str = "url_id") -> DataFrame:
    """``key, verdict, seconds`` of ``key, url``: the first check that fails, else ``ok``, and the host's delay.

    In order: scheme, user part, private host, host not in ``allowed`` (column host), rules. ``status`` (host, status) is the answer to the request for
    the rules: 404 allows all, other errors and hosts without an answer deny all. The longest prefix decides, equal ones allow.
    Only prefixes as long as some rule of the host are made, so a URL gives as many rows as its host has lengths of rules.
    Null URLs have no scheme. ``key`` is unique.
    """
    scheme, user, name, path = url_parts(F.col("url"))
    rows = urls.select(key, scheme.alias("scheme"), user.alias("user"), name.alias("host"), path.alias("path"))
    told = rules.groupBy("host").agg(F.max("seconds").alias("seconds"), F.array_sort(F.collect_set(F.length("prefix"))).alias("lengths"))
    hosts = status.join(told, "host", "left")
    if allowed is not None:
        hosts = hosts.join(allowed.select("host", F.lit(True).alias("known")).distinct(), "host", "full")
    rows = rows.join(hosts, "host", "left")
    made = rows.where("status < 400").select(key, "host", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"), "path").withColumn("prefix", F.expr("left(path, n)"))
    best = made.join(rules.select("host", "prefix", "allow"), ["host", "prefix"]).groupBy(key).agg(F.max_by("allow", "n").alias("allow"))
    denied = ~F.coalesce(F.when(F.col("status") == 404, True).when(F.col("status") < 400, F.coalesce("allow", F.lit(True))), F.lit(False))
    verdict = F.when(~F.col("scheme").isin("http", "https") | (F.col("host") == ""), "unsupported_scheme").when(F.col("user") != "", "userinfo_blocked").when(private_host(F.col("host")), "private_address_blocked")
    if allowed is not None:
        verdict = verdict.when(F.col("known").isNull(), "redirect_blocked")
    return rows.join(best, key, "left").select(key, verdict.when(denied, "robots_denied").otherwise("ok").alias("verdict"), "seconds")
