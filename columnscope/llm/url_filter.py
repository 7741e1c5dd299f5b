"""URL rules whose blocks follow redirects and canonical links.

Pages and the targets of their redirects and canonical links are nodes of a graph; its connected components are the
aliases of one another. A page that a rule fits gets that rule's verdict, the longest rule winning, so an explicit
allow holds even where an alias is blocked. A page without a rule is blocked if any alias is blocked by a rule, and
allowed otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from columnscope.llm.components import components
from columnscope.llm.storage import materialise, only


@dataclass(frozen=True)
class UrlRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``; ``path`` begins with a slash or is empty."""

    host: str
    path: str
    verdict: str

    def __post_init__(self):
        if self.verdict not in ("allow", "block"):
            raise ValueError("a rule's verdict is allow or block")

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What is between the first :// and the next /, ?, # or end, A-Z lower-cased; empty without ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _matched(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """The longest fitting rule as (verdict, rule), null if none fits; of equal names the blocking one."""
    hits = [
        F.when(
            ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path),
            F.struct(F.lit(rule.verdict).alias("verdict"), F.lit(rule.name).alias("rule")),
        )
        for rule in sorted(rules, key=lambda r: (-len(r.name), r.verdict != "block"))
    ]
    return F.coalesce(*hits) if hits else F.lit(None).cast("struct<verdict:string,rule:string>")


def _without_dots(path: Column) -> Column:
    """A path from the root without the segments ``.`` and ``..``, which stand for this folder and the one above."""
    def step(kept: Column, segment: Column) -> Column:
        above = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))
        return F.when(segment == "..", above).when(segment == ".", kept).otherwise(F.concat(kept, F.array(segment)))

    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    # the root is kept; a path that ends in a dot segment names a folder
    folded = F.array_join(F.aggregate(F.slice(segments, F.lit(2), F.size(segments)), F.array(F.lit("")), step), "/")
    folded = F.when(last.isin(".", ".."), F.concat(folded, F.lit("/"))).otherwise(folded)
    return F.when(path.contains("/."), folded).otherwise(path)


def _key(url: Column) -> Column:
    """One spelling of a URL as a node: scheme and host in lower case, without fragment and dot segments; null if empty."""
    trimmed = F.trim(url)
    whole = F.regexp_extract(trimmed, r"(?s)^([^#]*)", 1)
    scheme = F.lower(F.regexp_extract(whole, r"(?s)^(.*?)://", 1))
    path = F.regexp_extract(whole, r"(?s)^.*?://[^/?#]*([^?]*)", 1)
    query = F.regexp_extract(whole, r"(?s)^.*?://[^?]*(\?.*)$", 1)
    rooted = F.when((path == "") & (query == ""), F.lit("/")).otherwise(_without_dots(path))
    return F.when(whole.contains("://"), F.concat(scheme, F.lit("://"), host_of(whole), rooted, query))


def _absolute(target: Column, base: Column) -> Column:
    """``target`` as seen from the page ``base``: whole, without scheme, from the root, or from the page's folder."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"(?s)^(.*?://[^?#]*)", 1)
    folder = F.when(page == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_extract(page, r"(?s)^(.*?://.*/)", 1))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.startswith("?"), F.concat(page, target))
        .when(target != "", F.concat(folder, target))
    )


# The inside of a tag: quoted values are units, whatever they hold; a tag with a lone quote ends at its first ``>``. Possessive
# throughout, so neither long values nor markup without an end makes the search go back.
_INSIDE = r"""((?:[^<>"']++|"[^"]*+"|'[^']*+')*+(?=>)|[^<>]*+)>"""
_ATTRIBUTE = r"""([^\s"'=<>/]++)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)"""


def _attribute(tag: Column, name: str) -> Column:
    """Value of a tag's first attribute of that name, without its quotes; null if it has none."""
    both = F.arrays_zip(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), 1).alias("name"), F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), 2).alias("value"))
    value = F.get(F.filter(both, lambda p: F.lower(p["name"]) == name), F.lit(0))["value"]
    return F.trim(F.replace(F.regexp_replace(value, r"""^["']|["']$""", ""), F.lit("&amp;"), F.lit("&")))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target) of every canonical link and meta refresh in the pages' markup, as node names.

    Comments are no markup. A link is canonical if that is one of the words of its ``rel``.
    """
    # a plain search first: most pages have neither tag
    held = only(pages, url=url, html=html).where(F.lower("html").contains("canonical") | F.lower("html").contains("refresh"))
    shown = held.select("url", F.regexp_replace("html", r"(?s)<!--(?:.*?-->|.*$)", " ").alias("html"))

    def of_kind(kind: str) -> Column:
        return F.transform(F.regexp_extract_all("html", F.lit(rf"(?i)<{kind}\b{_INSIDE}"), 1), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("tag")))

    tags = shown.select("url", F.explode(F.concat(of_kind("link"), of_kind("meta"))).alias("found")).select("url", "found.*")
    canonical = F.when(F.array_contains(F.split(F.lower(_attribute(F.col("tag"), "rel")), r"\s+"), "canonical"), _attribute(F.col("tag"), "href"))
    aim = F.regexp_extract(_attribute(F.col("tag"), "content"), r"""(?i)\burl\s*=\s*["']?([^"'\s>;]+)""", 1)
    refresh = F.when(F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh", aim)
    target = F.when(F.col("kind") == "link", canonical).otherwise(refresh)
    return tags.select(_key(F.col("url")).alias("source"), _key(_absolute(target, F.col("url"))).alias("target")).where(
        "source is not null and target is not null and source <> target"
    ).distinct()


def judge(pages: DataFrame, rules: tuple[UrlRule, ...], id: str = "page_id", url: str = "url", html: str | None = "html",
          redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict, alias_of) for every row of ``pages``.

    ``redirects`` may add (source, target) URLs, such as a crawler's log of HTTP redirects. ``alias_of`` is the first
    URL, in order, of the group of aliases, or null where a page has none. A page that no rule fits is blocked if a
    rule blocks any URL of its group (pages or mere targets), else it gets ``default``. A null URL, or one without
    ``://``, has empty host and path, fits no rule and has no aliases. Rows are judged one by one, so repeated rows
    and null ids are returned as they are; an empty table gives an empty result; other columns are not looked at.
    Rules are a short list given by the caller and enter the plan as expressions.
    """
    columns = {"id": id, "url": url} | ({"html": html} if html else {})
    held = only(pages, **columns)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = held.select("id", host.alias("host"), path.alias("path"), _key(F.col("url")).alias("node")).withColumn(
        "hit", _matched(F.col("host"), F.col("path"), rules)
    )
    links = page_links(held) if html else None
    if redirects is not None:
        given = redirects.select(_key(F.col("source")).alias("source"), _key(F.col("target")).alias("target")).where(
            "source is not null and target is not null and source <> target"
        )
        links = given if links is None else links.unionByName(given)
    if links is not None:
        links = materialise(links)
    if links is None or links.isEmpty():
        return _results(judged.withColumn("component", F.lit(None).cast("string")).withColumn("blocked", F.lit(False)), id, default)
    found = materialise(components(links, "source", "target"))
    member = found.withColumn("hit", _matched(host_of(F.col("id")), path_of(F.col("id")), rules))
    blocked = member.groupBy("component").agg(F.max(F.coalesce(F.col("hit.verdict") == "block", F.lit(False))).alias("blocked"))
    classes = found.withColumnRenamed("id", "node").join(blocked, "component")
    return _results(judged.join(classes, "node", "left"), id, default)


def _results(judged: DataFrame, id: str, default: str) -> DataFrame:
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("blocked"), F.lit("block")), F.lit(default))
    return judged.select(
        F.col("id").alias(id), "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), F.col("component").alias("alias_of")
    )
