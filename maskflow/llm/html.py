"""Main text of web pages: blocks outside menus and the like, less the lines that the page nearest by URL has as well."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskflow.llm.common import LOWER, UPPER, ship
from maskflow.session import materialise

ship(__name__)

# Elements whose content is no markup, the name of a tag, and the characters that decide where a tag ends.
RAW = re.compile(r"<(script|style|noscript|template|svg|textarea|title|iframe)\b", re.I)
NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)", re.I)
MARKS = re.compile(r"""[>"']""")
DIGITS = re.compile(r"&#([0-9]{8,});?")  # longer than any code point
# Elements that are no main text, words of a class or id that say so, elements that begin a new line.
OUTSIDE = frozenset("nav header footer aside form button select dialog menu object head figcaption fieldset".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices gdpr "
    "newsletter subscribe subscription paywall sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer "
    "comment comments reply replies disqus respond social share sharing related recommended popup modal widget pagination toolbar login search".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
WHOLE = frozenset("html body main article".split())
BREAKS = frozenset(
    "p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption section article main blockquote pre figure "
    "hr address details summary body html header footer nav aside form fieldset legend center".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LABEL = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)


def outside(name: str, attributes: str) -> bool:
    """Whether an element and all in it is no main text."""
    if name in OUTSIDE:
        return True
    if name in WHOLE or not attributes:
        return False
    for key, value in LABEL.findall(attributes):
        words = re.split(r"[^a-z]+", value.lower())
        if key.lower() == "role" and ROLES.intersection(words) or key.lower() != "role" and WORDS.intersection(words):
            return True
    return False


def unescape(text: str) -> str:
    """Character references decoded; numbers of any length are short ones first, since long ones cannot be converted."""
    if "&" not in text:
        return text
    return html.unescape(DIGITS.sub(lambda m: f"&#{(m[1].lstrip('0') or '0')[:8]};", text))


class Ends:
    """Where tags end in a page; quotes are matched once for the whole page, so that broken pages take linear time."""

    def __init__(self, source: str):
        self.size, self.marks, self.at = len(source), MARKS.findall(source), [m.start() for m in MARKS.finditer(source)]
        n = len(self.at)
        # For each mark: the next ">", and the ">" that ends a tag read from there, -1 where there is none.
        self.plain, self.quoted = [-1] * (n + 1), [-1] * (n + 1)
        following = {'"': -1, "'": -1}
        for k in range(n - 1, -1, -1):
            mark = self.marks[k]
            if mark == ">":
                self.plain[k] = self.quoted[k] = self.at[k]
            else:
                self.plain[k] = self.plain[k + 1]
                self.quoted[k] = self.quoted[following[mark] + 1] if following[mark] >= 0 else -1
                following[mark] = k

    def next(self, start: int) -> int:
        """The first ">" from `start` on, or -1."""
        return self.plain[bisect_left(self.at, start)]

    def outside_quotes(self, start: int) -> int:
        """The first ">" from `start` on that is in no quotes opened since, or -1."""
        return self.quoted[bisect_left(self.at, start)]


def tokens_of(source: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Start, end, slash, lower-cased name and attributes of each piece of markup; comments and the like have no name.

    A tag ends at the first ">" outside quotes or, where a quote stays open, at the first ">". What never ends is text,
    save comments and elements without markup inside, which go on to the end of the page.
    """
    ends, at = Ends(source), source.find("<")
    while at >= 0:
        end, slash, name, attributes = -1, "", "", ""
        if source.startswith("<!--", at):
            close = source.find("-->", at + 4)
            end = len(source) if close < 0 else close + 3
        elif (raw := RAW.match(source, at)) and (opened := ends.next(raw.end())) >= 0:
            close = re.compile(rf"</{raw[1]}\s*>", re.I).search(source, opened + 1)
            end = close.end() if close else len(source)
        elif tag := NAME.match(source, at):
            last = ends.outside_quotes(tag.end())
            last = last if last >= 0 else ends.next(tag.end())
            if last >= 0:
                end, slash, name, attributes = last + 1, tag[1], tag[2].lower(), source[tag.end() : last]
        elif source[at + 1 : at + 2] in ("!", "?", "/") and (last := ends.next(at + 2)) >= 0:
            end = last + 1
        if end >= 0:
            yield at, end, slash, name, attributes
        at = source.find("<", end if end >= 0 else at + 1)


def lines_of(source: str | None) -> tuple[list[str], list[int]]:
    """The lines of a page outside menus and the like, and for each of them the number of the innermost article or main
    element it stands in (none on pages without such text).

    Where a page has text in an article or main element, the lines are that text. An element that is never closed is
    left out by itself, not with all that follows.
    """
    if not source:
        return [], []
    tokens = list(tokens_of(source))
    closes: dict[str, int] = {}
    for _, _, slash, name, _ in tokens:
        if slash:
            closes[name] = closes.get(name, 0) + 1
    found: list[tuple[int, str]] = []
    block: list[str] = []
    within, articles, inside, at = [0], 0, [], 0

    def flush() -> None:
        line = " ".join("".join(block).split())
        if line:
            found.append((within[-1], line))
        block.clear()

    for start, end, slash, name, attributes in tokens:
        if not inside and start > at:
            block.append(unescape(source[at:start]))
        at = end
        if slash:
            closes[name] -= 1
        if inside:  # in an element that is left out: wait for its end
            if name == inside[-1]:
                if slash:
                    inside.pop()
                elif not attributes.endswith("/") and closes.get(name, 0) > len(inside):
                    inside.append(name)
            continue
        if not name or name in VOID:
            if name in ("br", "hr", "wbr"):
                block.append("" if name == "wbr" else " ")
            if name == "hr":
                flush()
            continue
        if not slash and closes.get(name, 0) and outside(name, attributes):
            flush()
            inside.append(name)
        elif name in BREAKS or name in ("article", "main"):
            flush()
            if name in ("article", "main") and not slash:
                articles += 1
                within.append(articles)
            elif name in ("article", "main") and len(within) > 1:
                within.pop()
    if not inside and at < len(source):
        block.append(unescape(source[at:]))
    flush()
    explicit = [(part, line) for part, line in found if part]
    return [line for _, line in explicit or found], [part for part, _ in explicit]


def deleted(shared: set[int], parts: list[int]) -> set[int]:
    """Which of the shared lines are no main text. Outside explicit articles all are. An article or main element goes if
    all its own lines are shared and another one of the page has lines that are not: teasers, or text around an article.
    Where part of an element is shared, or all of the page as in near copies, the lines stay.
    """
    if not parts:
        return shared
    kept = {part for k, part in enumerate(parts) if k not in shared}
    return {k for k in shared if kept and parts[k] not in kept}


# Longest common subsequence


def _lengths(a: list[int], b: list[int]) -> list[int]:
    """Of the longest common subsequence of a and each start of b, by one bit for each line of b."""
    places: dict[int, int] = {}
    for k, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(b)) - 1
    rest = full
    for x in a:
        both = rest & places.get(x, 0)
        rest = ((rest + both) | (rest - both)) & full
    taken = np.unpackbits(np.frombuffer((~rest & full).to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return [0, *np.cumsum(taken).tolist()]


def common(a: list[int], b: list[int]) -> list[int]:
    """Positions in `a` of a longest common subsequence with `b`, halving `a` (Hirschberg) in memory linear in the lines."""
    shared = set(a) & set(b)
    here = [k for k, x in enumerate(a) if x in shared]
    there = [x for x in b if x in shared]
    found, stack = [], [(0, len(here), 0, len(there))]
    while stack:
        i, j, k, n = stack.pop()
        while i < j and k < n and a[here[i]] == there[k]:
            found.append(here[i])
            i, k = i + 1, k + 1
        while i < j and k < n and a[here[j - 1]] == there[n - 1]:
            j, n = j - 1, n - 1
            found.append(here[j])
        if i >= j or k >= n:
            continue
        if j - i == 1:
            if a[here[i]] in there[k:n]:
                found.append(here[i])
            continue
        mid = (i + j) // 2
        left = _lengths([a[x] for x in here[i:mid]], there[k:n])
        right = _lengths([a[x] for x in reversed(here[mid:j])], there[k:n][::-1])
        cut = k + max(range(n - k + 1), key=lambda c: left[c] + right[n - k - c])
        stack += [(i, mid, k, cut), (mid, j, cut, n)]
    return sorted(found)


def digests(lines: list[str]) -> list[int]:
    return [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x in lines]


# Pairs of pages


def host_of(url: str | Column) -> Column:
    column = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    return F.translate(F.regexp_extract(column, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: str | Column) -> Column:
    column = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    return F.regexp_extract(column, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def alike(a: str, b: str) -> Column:
    """Number of equal path segments from the start."""
    pairs = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: x.eqNullSafe(y))
    return F.coalesce(F.nullif(F.array_position(pairs, F.lit(False)), F.lit(0)) - 1, F.size(pairs))


def neighbours(paths: DataFrame) -> DataFrame:
    """For each distinct (host, path) the path next to it in the order of its host that has more segments in common.

    Rows are sorted by ranges, so that a large host is spread over many tasks; only the ends of ranges are compared
    across them. Ties go to the path before. Hosts with one path give no rows.
    """
    ranged = paths.repartitionByRange("host", "path").withColumn("range", F.spark_partition_id())
    ranged = materialise(ranged, "paths")
    own = Window.partitionBy("range").orderBy("host", "path")
    here = F.struct("host", "path")
    near = ranged.withColumns({"before": F.lag(here).over(own), "after": F.lead(here).over(own)})
    ends = ranged.groupBy("range").agg(F.min(here).alias("first"), F.max(here).alias("last"))
    over = Window.orderBy("range")  # a row for each range
    ends = ends.select("range", F.lag("last").over(over).alias("ahead"), F.lead("first").over(over).alias("behind"))
    near = near.join(F.broadcast(ends), "range")
    near = near.withColumns({"before": F.coalesce("before", "ahead"), "after": F.coalesce("after", "behind")})
    ok = {k: F.col(f"{k}.host") == F.col("host") for k in ("before", "after")}
    near = near.withColumns({k: F.when(ok[k], F.col(f"{k}.path")) for k in ok})
    later = F.col("before").isNull() | (F.col("after").isNotNull() & (alike("path", "after") > alike("path", "before")))
    near = near.withColumn("partner", F.when(later, F.col("after")).otherwise(F.col("before")))
    return near.where("partner is not null and host <> ''").select("host", "path", "partner")


@dataclass(frozen=True)
class Settings:
    keep_article: bool = True  # lines of an article that has lines of its own stay though another page has them


def extract(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """page_id, url, text, n_chars (code points) and n_shared of every row of `pages`.

    Each page is compared with the page nearest by URL on its host: lines of a longest common subsequence of both are
    shared (`n_shared`). They are deleted; on pages with an explicit article whole elements are (see `deleted`). Of several pages with one host and path
    the one with the smallest id stands for all, and they are not compared with each other; pages without a host or
    without others on it have no shared lines. Null and empty pages give the empty text. Repeated rows give repeated rows.
    """
    addressed = pages.select("page_id", "url", "html", host_of("url").alias("host"), path_of("url").alias("path"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"host": batch.host, "path": batch.path, "page": batch.page, "lines": [digests(lines_of(h)[0]) for h in batch.html]})

    light = addressed.where("host <> ''").select("host", "path", F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page"), "html")
    light = light.mapInPandas(hashed, "host string, path string, page string, lines array<long>")
    order = F.struct(F.length("page").alias("l"), "page", "lines")
    stand = materialise(light.groupBy("host", "path").agg(F.min(order)["lines"].alias("lines")), "lines")
    pairs = neighbours(stand.select("host", "path"))
    other = stand.select("host", F.col("path").alias("partner"), F.col("lines").alias("other"))
    pairs = pairs.join(other, ["host", "partner"]).select("host", "path", "other")
    joined = addressed.join(pairs, ["host", "path"], "left")
    keep = settings.keep_article

    def extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, shared = [], []
            for source, other in zip(batch.html, batch.other, strict=True):
                lines, parts = lines_of(source)
                both = set(common(digests(lines), [int(x) for x in other])) if other is not None else set()
                gone = deleted(both, parts if keep else [])
                shared.append(len(both))
                texts.append("\n".join(x for k, x in enumerate(lines) if k not in gone))
            yield pd.DataFrame({"page_id": batch.page_id, "url": batch.url, "text": texts, "n_chars": [len(t) for t in texts], "n_shared": shared})

    kind = pages.schema["page_id"].dataType.simpleString()
    sent = joined.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "other")
    done = sent.mapInPandas(extracted, "page_id string, url string, text string, n_chars long, n_shared long")
    return done.withColumn("page_id", F.col("page_id").cast(kind))
