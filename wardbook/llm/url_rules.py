"""Block and allow pages by host rules, carried along redirects."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from html import unescape
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardbook.llm.components import component_labels
from wardbook.llm.shared import staged
from wardbook.operators.keyed import left_join_unique


@dataclass(frozen=True)
class Rule:
    """``verdict`` for the host and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# Fixed values of the query.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def _lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/ ? #`` or the end, A-Z lower-cased."""
    return F.coalesce(_lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(url: Column) -> Column:
    """The url by which aliases meet: scheme and host lower-cased, without fragment and without
    the port its scheme has anyway, an empty path as ``/``."""
    origin = _lowered(F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1))
    origin = F.regexp_replace(origin, r"(?s)^(http://[^/]*):80$|^(https://[^/]*):443$", "$1$2")
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    slash = F.when(rest.startswith("/"), "").otherwise("/")
    return F.when(url.contains("://"), F.concat(origin, slash, rest)).otherwise(url)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits as ``struct(name, verdict)``, null if none does."""
    chosen = F.lit(None)
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        named = F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))
        chosen = F.when(fits, named).otherwise(chosen)
    return chosen


# What holds no tags: comments, scripts and styles, to their end or that of the page.
_NO_TAGS = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)")
# Quoted values may hold any character, ``>`` too.
_TAG = re.compile(r"(?is)<(link|meta|base)(?=[\s/>])((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_REFRESH = re.compile(r"(?is)\s*[\d.]+\s*[;,\s]\s*(?:url\s*=\s*)?(.+)")


# A name without its semicolon is text where a parameter or a longer name could go on.
_ENTITY = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+);?|([A-Za-z][A-Za-z0-9]*(?:;|(?![=A-Za-z0-9]))))")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
_PARTS = re.compile(r"(?s)((.*?:)//[^/?#]*)([^?#]*)")


def decoded(value: str) -> str:
    """The value of an attribute with its character references replaced."""
    return _ENTITY.sub(lambda m: html5.get(m[1], m[0]) if m[1] else unescape(m[0]), value)


def _without_dots(path: str) -> str:
    kept: list[str] = []
    steps = path.split("/")[1:]
    for step in steps:
        if step == "..":
            del kept[-1:]
        elif step != ".":
            kept.append(step)
    if steps[-1] in (".", ".."):
        kept.append("")
    return "/" + "/".join(kept)


def resolved(page: str, target: str) -> str | None:
    """The url that a link of ``page`` leads to; null if it names no page or ``page`` itself."""
    target = decoded(target).strip()
    scheme, own = _SCHEME.match(target), _PARTS.match(page)
    if scheme:
        return target if target.startswith("//", scheme.end()) else None
    if not own or target[:1] in ("", "#"):
        return None
    if target.startswith("//"):
        return own[2] + target
    if target.startswith("?"):
        return own[0] + target
    path, rest = re.match(r"(?s)([^?#]*)(.*)", target).groups()
    folder = "" if path.startswith("/") else own[3][: own[3].rfind("/") + 1] or "/"
    return own[1] + _without_dots(folder + path) + rest


def _attributes(text: str) -> dict[str, str]:
    """The attributes of a tag by lower-cased name, as written; of repeated ones the first."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), next((v for v in values if v), ""))
    return found


def targets_in(page: str, html: str) -> list[str]:
    """The urls that the canonical links and refreshes of a page lead to.

    Tags in comments, scripts and styles do not count. ``rel`` is a list of words; the first
    ``<base href>`` is what relative targets stand by.
    """
    base, raw = None, []
    for tag, text in _TAG.findall(_NO_TAGS.sub(" ", html)):
        own = _attributes(text)
        if tag.lower() == "base":
            base = base or own.get("href")
        elif tag.lower() == "link":
            if "canonical" in decoded(own.get("rel", "")).lower().split():
                raw.append(own.get("href", ""))
        elif decoded(own.get("http-equiv", "")).strip().lower() == "refresh":
            to = _REFRESH.fullmatch(decoded(own.get("content", "")))
            if to:
                value = to[1].strip()
                quote = value[:1]
                raw.append(value[1:].split(quote)[0] if quote in ("'", '"') else value)
    stands_by = (base and resolved(page, base)) or page
    return [to for value in raw if (to := resolved(stands_by, value))]


def _find_targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        urls, pages = batch.column("url").to_pylist(), batch.column("html").to_pylist()
        pairs = [(u, to) for u, html in zip(urls, pages, strict=True) for to in targets_in(u, html)]
        columns = zip(*pairs, strict=True) if pairs else ([], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.string()) for c in columns], names=["url", "target"]
        )


def alias_links(pages: DataFrame) -> DataFrame:
    """``url, target`` of all canonical links and meta refreshes in ``html``.

    Relative targets are resolved against the page's url, or its ``<base href>``. Pages without
    either word are never taken apart.
    """
    may_link = F.lower("html").rlike("canonical|refresh|&#")
    named = pages.where(F.col("url").isNotNull() & may_link).select("url", "html")
    return named.mapInArrow(_find_targets, "url string, target string")


def judge(
    pages: DataFrame, rules: Sequence[Rule] = RULES, redirects: DataFrame | None = None
) -> DataFrame:
    """``page_id, url, host, path, rule, verdict, component`` of every page.

    A page's own rule decides first. Pages that redirects or canonical links join, in
    either direction and over any number of hops, also through urls that are no page, are
    aliases: where no own rule fits, an alias of a blocked url is blocked unless another
    alias is allowed by a rule, and all others are allowed. ``redirects`` may add
    ``url, target`` rows, say from a crawl log. Urls that differ in their fragment, the case
    of scheme and host, the usual port or an empty path are one alias; rules are judged on the
    url as it is. Other columns, whatever their names, are not read.

    Null urls and urls without ``://`` have empty host and path, no rule and no alias;
    they are allowed. ``component`` is the smallest url of the aliases, as ``key_of`` writes it. Repeated rows get
    equal verdicts, one row each; an empty table gives an empty one.
    """
    links = alias_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("url", "target"))
    links = links.select(key_of(F.col("url")).alias("a"), key_of(F.col("target")).alias("b"))
    labels = component_labels(staged(links.dropna(), "links"))
    members = labels.withColumn(
        "own", rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]
    )
    carried = members.groupBy("component").agg(
        F.coalesce(F.max(F.col("own") == "allow"), F.lit(False)).alias("any_allow"),
        F.coalesce(F.max(F.col("own") == "block"), F.lit(False)).alias("any_block"),
    )
    aliases = left_join_unique(labels, carried, ["component"]).select(
        F.col("node").alias("key"),
        "component",
        F.when(F.col("any_block") & ~F.col("any_allow"), "block").otherwise("allow").alias("alias"),
    )
    keyed = pages.select("page_id", "url", key_of(F.col("url")).alias("key"))
    found = left_join_unique(keyed, aliases, ["key"])
    judged = found.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    judged = judged.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    return judged.select(
        "page_id",
        "url",
        "host",
        "path",
        F.col("own")["name"].alias("rule"),
        F.coalesce(F.col("own")["verdict"], F.col("alias"), F.lit("allow")).alias("verdict"),
        "component",
    )
