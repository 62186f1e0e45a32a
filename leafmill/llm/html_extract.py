"""Main text of web pages by consensus paths of each host.

1. Each page's choice is the outermost article or main element around most of its text outside menus, headers, footers,
   adverts and the like; without one, the deepest container that holds all of that text. Its path, from tag names and
   classes without digits, is its vote.
2. Spark sums the votes of each host by path, pre-aggregated in the tasks, so a host with a third of all pages is no
   large group; the path with most votes wins.
3. Each page is extracted again from the containers on its host's winning path if they hold all blocks of the page's own
   choice, else from its own choice.

A form goes, unless it frames most of the page's paragraphs. Pages are read in one pass, in time and memory that grow with
their length alone.

Character references are decoded, white space in a block becomes one space, blocks are joined by line feeds. Null or
empty pages, and pages without text, give an empty text; pages without a host vote together. A column called text is
replaced and html is left out; other columns pass through.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_slices, materialize, table

#: Element names by their role in a page.
RAW = frozenset("script style title textarea noscript template iframe svg select xmp".split())
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("aside button dialog footer head menu nav object".split())
CONTAINERS = frozenset("article body div main section td".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
#: Words of a class, id or role that mark what is not the article, and those that may stand beside them. A name of other
#: words as well ("related-work", "notice-text") marks nothing.
NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disqus footer "
    "masthead menu modal nav navbar navigation newsletter notice notification notifications overlay pagination popup promo promoted promotion related reply replies search share sharing sidebar social sponsor "
    "sponsored subscribe toolbar widget widgets".split()
)
BESIDE = frozenset(
    "area articles aside bar block body bottom box button buttons column container content-info footer form group header holder icons inner items left links list main module outer page panel posts primary right row secondary "
    "section site signup slot stories sub thread top unit wrap wrapper zone".split()
)
#: A quoted value, and the number of them in a tag, beyond which quotes are taken for plain characters.
LONGEST_VALUE, MOST_VALUES = 4096, 32
MOST = 0.8
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_WORDS = re.compile(r"[\s_\d-]+")


def marks_other(names: dict[str, str]) -> bool:
    """Whether a class, an id or a role says that an element is not of the article."""
    for name in " ".join(names.values()).lower().split():
        words = [w for w in _WORDS.split(name) if w]
        if any(w in NOT_ARTICLE for w in words) and all(w in NOT_ARTICLE or w in BESIDE for w in words):
            return True
    return False


def tag_end(source: str, at: int) -> int:
    """The place of the > that ends a tag; one inside a quoted value does not. -1 if there is none."""
    here = at
    for _ in range(MOST_VALUES):
        m = _STOP.search(source, here)
        if m is None:
            break
        if m.group() == ">":
            return m.start()
        close = source.find(m.group(), m.end(), m.end() + LONGEST_VALUE)
        if close < 0:
            return source.find(">", m.end())
        here = close + 1
    return source.find(">", at)


def tokens(source: str) -> Iterator[tuple[str, str, str]]:
    """(tag, "/" of an end tag, attributes) or ("", "", text) of a page, in one pass; comments and raw elements are left out."""
    at, n = 0, len(source)
    ends = re.compile(r"</(?:" + "|".join(sorted(RAW)) + r")\s*>", re.I)
    while at < n:
        k = source.find("<", at)
        if k < 0:
            yield "", "", source[at:]
            return
        if k > at:
            yield "", "", source[at:k]
        if source.startswith("<!--", k):
            at = source.find("-->", k + 4)
            at = n if at < 0 else at + 3
            continue
        end = "/" if source.startswith("/", k + 1) else ""
        m = _NAME.match(source, k + 1 + len(end))
        if m is None:
            if source[k + 1 : k + 2] in ("!", "?", "/") and (close := source.find(">", k)) >= 0:
                at = close + 1
            else:
                yield "", "", "<"
                at = k + 1
            continue
        close = tag_end(source, m.end())
        if close < 0:  # no tag ends any more
            yield "", "", source[k:]
            return
        tag, at = m.group().lower(), close + 1
        if tag in RAW and not end:
            if not source[m.end() : close].endswith("/") or tag not in ("svg", "iframe"):
                last = next((x for x in ends.finditer(source, at) if x.group()[2:].lower().startswith(tag)), None)
                at = n if last is None else last.end()
            continue
        yield tag, end, source[m.end() : close]


class Page:
    """The blocks of a page, each with the path of its innermost container.

    Paths are numbered in a tree: `above` holds the number of each one's parent, -1 for the outermost.
    """

    def __init__(self, source: str):
        self.above: list[int] = []
        self.labels: list[str] = []
        self.numbers: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[str, int, int]] = []  # text, path, characters in links
        self.read(source)

    def read(self, source: str) -> None:
        stack: list[tuple[str, int, bool]] = []  # tag, path of the innermost container, left out
        opened: dict[str, list[int]] = {}  # the places of each open tag in the stack
        parts: list[str] = []
        linked = form = forms = 0
        in_link = False
        form_of: list[int] = []  # of each block the form around it, 0 for none
        article_of: list[bool] = []  # whether it is a paragraph, or in an article

        def close_block() -> None:
            nonlocal linked
            if parts:
                text = " ".join(entities.unescape("".join(parts)).split())
                if text:
                    self.blocks.append((text, stack[-1][1] if stack else -1, min(linked, len(text))))
                    form_of.append(form)
                    article_of.append(bool(opened.get("p") or opened.get("article") or opened.get("main")))
                parts.clear()
            linked = 0

        def pop_to(k: int) -> None:
            nonlocal form
            while len(stack) > k:
                tag = stack.pop()[0]
                opened[tag].pop()
                if tag == "form":
                    form = 0

        for tag, end, attrs in tokens(source):
            if not tag:
                if not (stack and stack[-1][2]):
                    parts.append(attrs)
                    if in_link:
                        linked += len(attrs.strip())
                continue
            if tag == "br":
                parts.append(" ")
                continue
            if tag == "a":
                in_link = not end
            names = {} if end or not attrs else {a.lower(): b or c or d for a, b, c, d in _NAMES.findall(attrs)}
            marked = bool(names) and marks_other(names)
            if tag not in BLOCKS and tag not in SKIPPED and not marked:
                if end and opened.get(tag):  # an inline element that was left out
                    pop_to(opened[tag][-1])
                continue
            if end:
                close_block()
                if opened.get(tag):
                    pop_to(opened[tag][-1])
                continue
            close_block()
            if tag in VOID:
                continue
            if stack and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and tag in BLOCKS:
                pop_to(len(stack) - 1)
            elif tag in CLOSED_BY:
                limit = max((opened[t][-1] for t in ("ul", "ol", "dl", "table") if opened.get(t)), default=-1)
                own = [opened[t][k] for t in CLOSED_BY[tag] if opened.get(t) and (k := bisect_right(opened[t], limit)) < len(opened[t])]
                if own:
                    pop_to(min(own))
            inside = bool(opened.get("article") or opened.get("main"))
            out = bool(stack and stack[-1][2]) or tag in SKIPPED or tag == "header" and not inside or marked and tag not in ("html", "body", "article", "main", "form")
            path = stack[-1][1] if stack else -1
            if tag in CONTAINERS and not out:
                label = tag
                if names.get("class"):
                    label += "".join("." + c for c in sorted(set(re.sub(r"\d+", "", names["class"]).lower().split())))
                key = path, label
                path = self.numbers.get(key, -1)
                if path < 0:
                    path = self.numbers[key] = len(self.above)
                    self.above.append(key[0])
                    self.labels.append(label)
            if tag == "form" and not form:
                forms += 1
                form = forms
            opened.setdefault(tag, []).append(len(stack))
            stack.append((tag, path, out))
        close_block()
        if forms:  # a form goes, unless it is the frame of the whole page
            size = [0] * (forms + 1)
            for (text, _, _), f, good in zip(self.blocks, form_of, article_of, strict=True):
                size[f] += len(text) * good
            frame = [f > 0 and 2 * x > sum(size) for f, x in enumerate(size)]
            self.blocks = [x for x, f in zip(self.blocks, form_of, strict=True) if not f or frame[f]]

    def sums(self, values: list[int]) -> list[int]:
        """The sum of a value of each block over each path and what is below it."""
        out = [0] * len(self.above)
        for (_, p, _), v in zip(self.blocks, values, strict=True):
            if p >= 0:
                out[p] += v
        for p in range(len(out) - 1, -1, -1):  # parents have smaller numbers
            if self.above[p] >= 0:
                out[self.above[p]] += out[p]
        return out

    def choice(self) -> int:
        """The path of the article or main element around most of the text that is not in links, else of the deepest
        container with all text; -1 without any."""
        own = [len(t) - n for t, _, n in self.blocks]
        total = sum(own)
        if not total:
            return -1
        weight, whole = self.sums(own), self.sums([1] * len(own))
        depth = [0] * len(self.above)
        for p, a in enumerate(self.above):
            depth[p] = depth[a] + 1 if a >= 0 else 0
        articles = [p for p, n in enumerate(weight) if n >= MOST * total and self.labels[p].split(".")[0] in ("article", "main")]
        if articles:
            return min(articles, key=lambda p: (depth[p], self.labels[p]))
        return max((p for p, n in enumerate(whole) if n == len(own)), key=lambda p: depth[p], default=-1)

    def path(self, p: int) -> str | None:
        """The labels of a path, outermost first."""
        out: list[str] = []
        while p >= 0:
            out.append(self.labels[p])
            p = self.above[p]
        return " ".join(reversed(out)) or None

    def number(self, path: str | None) -> int:
        """The number of a path, -1 if the page lacks it."""
        p = -1
        for label in (path or "").split(" "):
            p = self.numbers.get((p, label), -2)
            if p < 0:
                return -1
        return p

    def on(self, path: int) -> list[bool]:
        """Which blocks are inside the containers on a path; all blocks for no path."""
        if path < 0:
            return [True] * len(self.blocks)
        inside = [False] * len(self.above)
        for p, a in enumerate(self.above):
            inside[p] = p == path or a >= 0 and inside[a]
        return [p >= 0 and inside[p] for _, p, _ in self.blocks]

    def text(self, path: str | None) -> str:
        """The blocks inside the containers on a path if these hold the page's own choice, else those of the choice."""
        kept = self.on(self.choice())
        if (p := self.number(path)) >= 0:
            wide = self.on(p)
            if all(w or not k for w, k in zip(wide, kept, strict=True)):
                kept = wide
        return "\n".join(t for (t, _, _), k in zip(self.blocks, kept, strict=True) if k)


def host_column(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with most votes of the pages (host, html); ties to the first by name."""

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in in_slices(batches):
            for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                page = Page(source) if source else None
                path = page.path(page.choice()) if page else None
                if path is not None:
                    n[host, path] += 1
            if len(n) > 100_000:
                yield rows(n)
                n.clear()
        yield rows(n)

    def rows(n: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([h for h, _ in n], pa.string()), pa.array([p for _, p in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["host", "path", "n"])

    summed = pages.select("host", "html").mapInArrow(votes, "host string, path string, n long").groupBy("host", "path").agg(F.sum("n").alias("n"))
    first = F.row_number().over(W.partitionBy("host").orderBy(F.desc("n"), "path"))
    return summed.withColumn("_k", first).filter("_k = 1").select("host", "path")


def extract(pages: DataFrame, small_bytes: int = 16 << 20) -> DataFrame:
    """pages (url, html, ...) with text instead of html."""
    spark = pages.sparkSession
    kept = [f for f in pages.schema.fields if f.name not in ("html", "text")]
    names = [f.name for f in kept]
    hosted = pages.select(*names, F.col("html").cast("string").alias("html"), host_column(F.col("url")).alias("_host"))
    winners = materialize(winning_paths(hosted.select(F.col("_host").alias("host"), "html")), "host-paths")
    weight = winners.agg(F.coalesce(F.sum(F.length("host") + F.length("path") + 100), F.lit(0)).alias("b")).first()["b"]
    small = weight <= small_bytes
    sent = spark.sparkContext.broadcast({r["host"]: r["path"] for r in winners.collect()} if small else None)
    rows = hosted if small else hosted.join(winners.withColumnsRenamed({"host": "_host", "path": "_path"}), "_host", "left")
    schema = T.StructType([*kept, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            if sent.value is None:
                paths = b.column(len(names) + 1).to_pylist()
            else:
                paths = [sent.value.get(h) for h in b.column(len(names) + 1).to_pylist()]
            texts = [Page(x).text(p) if x else "" for x, p in zip(b.column(len(names)).to_pylist(), paths, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(texts, pa.string())], names=[*names, "text"])

    return rows.select(*names, "html", "_host" if small else "_path").mapInArrow(run, schema)


def op4_consensus_paths(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: The article of every page of these tables, told by its tags alone.
OP4_SQL = r"""
WITH article AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS a FROM pages
), blocks AS (
  SELECT page_id, url, i, parts[i] AS b
  FROM (SELECT page_id, url, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT page_id, url, regexp_split_to_array(a, '</?(?:p|h1)>') AS parts FROM article))
), clean AS (
  SELECT page_id, url, i,
         trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(b, '<[^>]*>', ' ', 'g'),
                   '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS t
  FROM blocks
)
SELECT page_id, url, coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (WHERE t <> ''), '') AS text,
       length(coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (WHERE t <> ''), ''))::BIGINT AS n_chars
FROM clean GROUP BY page_id, url
"""
