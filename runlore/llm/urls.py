"""URL filters: host and path rules, and decisions that follow redirects and canonical links.

A rule decides the pages it fits. Pages that name each other by redirect or canonical link, or whose addresses differ
only in scheme, default port, fragment, tracking parameters or a closing slash, are one class; a page no rule fits
takes the decision of its class: allow where any member is explicitly allowed, else block where one is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlore.functions.text import bind
from runlore.llm.common import components, small_side

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parameters that don't change what an address names.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|\z)"
LINK = r"(?is)<link\b([^>]*)>"
META = r"(?is)<meta\b([^>]*)>"
CANONICAL = r"""(?is)(?<![\w-])rel\s*=\s*("(?:[^"]*\s)?canonical(?=["\s])|'(?:[^']*\s)?canonical(?=['\s])|canonical(?=[\s/]|\z))"""
REFRESH = r"(?is)(?<![\w-])http-equiv\s*=\s*[\"']?refresh\b"
HREF = r"(?is)(?<![\w-])href\s*=\s*[\"']?\s*([^\"'\s>]+)"
TARGET = r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null where there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"\A([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_form(url: Column) -> Column:
    """One string for all spellings of an address; null where there is no host."""
    host = F.regexp_replace(host_of(url), r":(80|443)\z", "")
    path = F.regexp_replace(path_of(url), r"/(index\.html?)?\z", "")
    query = F.regexp_extract(after_scheme(url), r"\A[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(host != "", F.concat(host, path, F.lit("?"), F.array_join(kept, "&")))


def decoded(t: Column) -> Column:
    """The text with its character references replaced: numeric ones, and the named ones that addresses need."""
    def characters(t: Column, pattern: str, prefix: str, base: int) -> Column:
        def one(t: Column, digits: Column) -> Column:
            code = F.conv(digits, base, 10).cast("long")
            fits = (code > 0) & (code != 38) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
            character = F.decode(F.unhex(F.lpad(F.hex(F.when(fits, code).otherwise(F.lit(63))), 8, "0")), "UTF-32")
            return F.when(fits, F.regexp_replace(t, F.concat(F.lit(prefix), digits, F.lit(";")), F.regexp_replace(character, r"([\\\\$])", r"\\\\$1"))).otherwise(t)

        return F.aggregate(F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(1))), t, one)

    t = characters(t, r"&#([0-9]{1,7});", "&#", 10)
    t = characters(t, r"&#[xX]([0-9a-fA-F]{1,6});", "&#[xX]", 16)
    for name, character in (("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">"), ("num", "#"), ("sol", "/"), ("colon", ":"), ("equals", "="), ("quest", "?")):
        t = F.replace(t, F.lit(f"&{name};"), F.lit(character))
    return F.regexp_replace(t, r"&(amp|AMP|#0*38|#[xX]0*26);", "&")  # last, so that nothing is decoded twice


def resolved(t: Column, url: Column) -> Column:
    """The address that ``t`` names on the page at ``url``; null for other schemes, and on a page without a host."""
    path = path_of(url)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, r"[^/]*\z", ""))
    from_root = F.when(t.startswith("/"), t).when(t.rlike(r"\A[?#]"), F.concat(path, t)).otherwise(F.concat(folder, t))
    plain = F.regexp_replace(F.regexp_extract(from_root, r"\A([^?#]*)", 1), r"(\A|/)(\.\.?)\z", "$1$2/")
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x)))
    steps = bind(F.split(plain, "/"), lambda parts: F.aggregate(F.slice(parts, 2, F.size(parts)), F.slice(parts, 1, 1), step))
    own = F.concat(F.lit("http://"), host_of(url), F.array_join(steps, "/"), F.regexp_extract(from_root, r"\A[^?#]*(.*)", 1))
    return (F.when(t.rlike(r"\A[a-zA-Z][a-zA-Z0-9+.-]*://"), t).when(t.startswith("//"), F.concat(F.lit("http:"), t))
            .when((t != "") & (host_of(url) != "") & ~t.rlike(r"\A[a-zA-Z][a-zA-Z0-9+.-]*:"), own))


def declared_targets(html: Column, url: Column) -> Column:
    """All addresses that a page names as its canonical one and as where it redirects to."""
    def named(tag: str, marked: str, address: str) -> Column:
        tags = F.filter(F.regexp_extract_all(html, F.lit(tag), F.lit(1)), lambda a: a.rlike(marked))
        return F.transform(tags, lambda a: F.regexp_extract(a, address, 1))

    found = F.transform(F.concat(named(LINK, CANONICAL, HREF), named(META, REFRESH, TARGET)), decoded)
    return F.filter(F.transform(found, lambda t: resolved(t, url)), lambda t: t.isNotNull())


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target) address pairs that the pages declare."""
    pairs = declared_targets(F.col(html), F.col(url))
    return pages.select(F.col(url).alias("source"), F.explode(pairs).alias("target")).where("source IS NOT NULL")


def matched_rules(addresses: DataFrame, rules: DataFrame, rule_count: int) -> DataFrame:
    """(id, rule, verdict) of each (id, host, path) that a rule fits: the longest, and allow before block if equal.

    rules: (host, path, verdict). A rule fits its host and every host that ends in a dot and it. Every address meets
    the rules of its host's endings, an equi join.
    """
    def endings(host: Column) -> Column:
        labels = F.split(host, r"\.")
        return bind(labels, lambda parts: F.transform(
            F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))

    r = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    ends = addresses.select("id", "path", F.explode(endings(F.col("host"))).alias("rule_host"))
    fits = ends.join(small_side(r, rule_count, 256), "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("n"), (F.col("verdict") == "allow").alias("allow"), rule.alias("rule"), "verdict"))
    return fits.groupBy("id").agg(best.alias("best")).select("id", "best.rule", "best.verdict")


def judge_urls(pages: DataFrame, rules: DataFrame, links: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict) of every row.

    Addresses are judged once each: repeated rows cost one. An address without ``://``, and null, has no host, belongs
    to no class and is allowed, as is all that nothing decides. Links to or from addresses that no row has still join
    classes. Null keys stay; empty tables give no rows; other columns are not read; rules or links may be empty.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.xxhash64(F.col(url)).alias("id"))
    addresses = rows.select("id", "url").distinct().select(
        "id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.xxhash64(canonical_form(F.col("url"))).alias("node"),
        canonical_form(F.col("url")).isNotNull().alias("known"))
    ruled = addresses.join(matched_rules(addresses.select("id", "host", "path"), rules, rules.count()), "id", "left")
    form = lambda c: F.when(canonical_form(F.col(c)).isNotNull(), F.xxhash64(canonical_form(F.col(c))))
    classes = components(links.select(form("source").alias("a"), form("target").alias("b")))
    rooted = ruled.withColumn("node", F.when(F.col("known"), F.col("node"))).join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    decided = rooted.where("verdict IS NOT NULL AND root IS NOT NULL").groupBy("root").agg(
        F.max(F.col("verdict") == "allow").alias("allowed"))
    method = F.when(F.col("allowed").isNull() | F.col("allowed"), "allow").otherwise("block")
    judged = rooted.join(decided, "root", "left").select("id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"))
    return rows.join(judged, "id").select(F.col("key").alias(key), "host", "path", "rule", "verdict")
