"""Links of listing pages. Pages arrive as rows (url, html); fetching them is fetch.py's. Survey IDs in brackets."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweft.functions import text as X
from seqweft.functions.urls import latest_url, resolve

_ANCHOR = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)')[^>]*>(.*?)</a>"""
# The entities that listings use.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
PARENT = "parent directory"  # fixed value: the label of the link upwards


def unescape(c: Column) -> Column:
    for entity, char in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def parent_rule(rule: str, href: Column, label: Column) -> Column:
    """Whether a link counts [FLT-07..10]: four rules that differ in case, containment and empty labels.

    both: href and label are there, label is not the parent's in any case. contains: href is there and not ../, and label does not
    contain the parent's. folders: label is not exactly the parent's and ends in /. exact: label alone, exactly.
    """
    title = PARENT.title()
    rules = {
        "both": (href != "") & (label != "") & (F.lower(label) != PARENT),
        "contains": (href != "") & (href != "../") & ~F.contains(F.lower(label), F.lit(PARENT)),
        "folders": (label != title) & F.endswith(label, F.lit("/")),
        "exact": label != title,
    }
    if rule not in rules:
        raise ValueError(f"rule: one of {', '.join(rules)}")
    return rules[rule]


def _anchors(html: Column, region: str | None, first: bool = False) -> Column:
    """The anchors with an href inside the elements named region, in order; region None takes the whole page, first the first region alone."""
    inside = F.regexp_extract_all(html, F.lit(rf"(?is)<{region}\b[^>]*>(.*?)</{region}>"), F.lit(1)) if region else F.array(html)
    inside = F.slice(inside, 1, 1) if first else inside
    return F.regexp_extract_all(F.array_join(inside, "\n"), F.lit(_ANCHOR), F.lit(0))


def _href(anchor: Column) -> Column:
    return X.strip(unescape(F.concat(F.regexp_extract(anchor, _ANCHOR, 1), F.regexp_extract(anchor, _ANCHOR, 2))))


def _label(anchor: Column) -> Column:
    return X.strip(unescape(F.regexp_replace(F.regexp_extract(anchor, _ANCHOR, 3), "<[^>]*>", "")))


def links(pages: DataFrame, region: str | None = "pre", rule: str = "both", url: str = "url", html: str = "html") -> DataFrame:
    """url, pos, href, label, abs_url, is_directory of each anchor with an href inside the elements named region [LNK-01, ARR-05, URL-01, FLT-11].

    Expressions only; region None takes the whole page. exact_links() parses instead.
    """
    found = pages.select(F.col(url).alias("url"), F.posexplode(_anchors(F.col(html), region)).alias("pos", "a"))
    rows = found.select("url", F.col("pos").cast("bigint").alias("pos"), _href(F.col("a")).alias("href"), _label(F.col("a")).alias("label"))
    kept = rows.where(parent_rule(rule, F.col("href"), F.col("label")))
    return kept.select("url", "pos", "href", "label", resolve(F.col("url"), F.col("href")).alias("abs_url"), F.endswith("href", F.lit("/")).alias("is_directory"))


class _Anchors(HTMLParser):
    def __init__(self, region: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.region, self.depth, self.open, self.found = region, 0, None, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == self.region:
            self.depth += 1
        elif tag == "a" and (self.depth or not self.region):
            self.open = [dict(attrs).get("href"), ""]

    def handle_data(self, data: str) -> None:
        if self.open:
            self.open[1] += data

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self.open:
            if self.open[0] is not None:
                self.found.append((self.open[0].strip(), self.open[1].strip()))
            self.open = None
        elif tag == self.region and self.depth:
            self.depth -= 1


def exact_links(pages: DataFrame, region: str | None = "pre", rule: str = "both") -> DataFrame:
    """links() with an HTML parser in place of patterns, for pages that nest or escape oddly; Arrow batches of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url, html in zip(batch.column(0), batch.column(1), strict=True):
                parser = _Anchors(region)
                parser.feed(html.as_py() or "")
                rows += [(url.as_py(), n, href, label, urljoin(url.as_py() or "", href)) for n, (href, label) in enumerate(parser.found)]
            yield pa.RecordBatch.from_pylist([dict(zip(("url", "pos", "href", "label", "abs_url"), r, strict=True)) for r in rows], schema=pa.schema([("url", pa.string()), ("pos", pa.int64()), ("href", pa.string()), ("label", pa.string()), ("abs_url", pa.string())]))

    found = pages.select("url", "html").mapInArrow(run, "url string, pos bigint, href string, label string, abs_url string")
    return found.where(parent_rule(rule, F.col("href"), F.col("label"))).withColumn("is_directory", F.endswith("href", F.lit("/")))


def directory_rows(pages: DataFrame, region: str = "pre") -> DataFrame:
    """bacteria_name, source_url, is_dir of a saved index [LNK-02, SRC-11, FLT-08, STR-08]; a page without the region fails."""
    checked = pages.select("url", F.concat(F.lit(f"<{region}>"), X.between(F.col("html"), f"<{region}>", f"</{region}>"), F.lit(f"</{region}>")).alias("html"))
    found = links(checked, region, "contains")
    return found.select(X.without_one_slash(F.col("label")).alias("bacteria_name"), F.col("abs_url").alias("source_url"), F.col("is_directory").alias("is_dir"))


def latest_listing(pages: DataFrame, region: str = "pre") -> DataFrame:
    """T10: base_url, latest_url, ok, error, assemblies of listings of current versions [LNK-03, SRC-14, FLT-09, STR-09].

    pages: url is the base's; html null where nothing was fetched, with its reason in a column error if there is one.
    One row for each page, from that page alone: pages of one URL, or of URLs that differ in closing slashes, stay apart.
    """
    reason = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    found = F.transform(_anchors(F.col("html"), region, first=True), lambda a: F.struct(_href(a).alias("href"), _label(a).alias("label")))
    kept = F.filter(found, lambda x: parent_rule("folders", x["href"], x["label"]))
    names = F.transform(kept, lambda x: X.without_slashes(x["label"]))
    has = F.regexp_like("html", F.lit(rf"(?i)<{region}\b"))
    error = F.when(F.col("html").isNull(), F.coalesce(reason, F.lit("not_fetched"))).when(~has, F.lit(f"no_{region}_tag"))
    out = pages.select(F.col("url").alias("base_url"), latest_url(F.col("url")).alias("latest_url"), error.alias("error"), F.coalesce(names, F.array().cast("array<string>")).alias("assemblies"))
    return out.select("base_url", "latest_url", F.col("error").isNull().alias("ok"), "error", "assemblies")
