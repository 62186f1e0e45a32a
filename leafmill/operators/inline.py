"""Runs of Markdown text: marks are matched by a fold over a block's delimiters, so that styles nest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import decode_entities

_URL = r"\s*(?:<[^<>\n]*>|(?:[^\s()<]|\([^\s()]*\))*)(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*"
#: Pieces of a text: escapes, breaks, code, links and tags in angle brackets, math, characters by name, brackets, runs of marks, text.
PIECES = (
    r"(?s)\\[!-/:-@\[-`{-~]|(?: {2,}|\\)\n *|(?<!`)(`+)(?!`).+?(?<!`)\1(?!`)|<[A-Za-z][A-Za-z0-9+.\-]{1,31}:[^\s<>]*>|<[^\s<>@]+@[^\s<>@]+>|</?[A-Za-z][^<>]*>|<!--.*?-->|\$[^\s$](?:[^$\n]*[^\s$])?\$|"
    r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z]\w*);|!\[|\[|\]\(" + _URL + r"\)|\]|\*+|_+|~+|\^+| ?\n *|(?:(?! *\n)[^\\`*_~^\[\]!<$&\n])+|."
)
MARK = r"^(?:\*+|_+|~+|\^+)$"
#: Style of a pair of marks by character and count.
PAIRED = {("*", 1): "italic", ("_", 1): "italic", ("*", 2): "bold", ("_", 2): "bold", ("~", 1): "sub", ("~", 2): "strike", ("^", 1): "sup"}
TEXT_STYLES = ("bold", "italic", "strike", "sub", "sup")

_LINKS = "array<struct<o:int,c:int,img:boolean,url:string>>"
_STATE = "struct<stack:array<struct<i:int,ch:string,len:int,rem:int,both:boolean,ctx:int>>,rem:int,pairs:array<struct<o:int,c:int,ch:string,n:int>>,ctx:array<int>,img:int>"


def _let(value: Column, body) -> Column:
    """body of a value that is computed once; inside lambdas Spark would compute it at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pieces(text: Column) -> Column:
    """Array of (i, raw): the pieces in order."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECES), F.lit(0))
    return F.transform(raw, lambda x, i: F.struct(i.cast("int").alias("i"), x.alias("raw")))


def _flanks(t: DataFrame) -> DataFrame:
    """Adds to each mark whether it can open and close, from the characters at its sides."""
    p = F.col("pieces")
    before = lambda x: F.when(x["i"] > 0, F.substring(F.get(p, x["i"] - 1)["raw"], -1, 1)).otherwise(" ")
    after = lambda x: F.coalesce(F.substring(F.get(p, x["i"] + 1)["raw"], 1, 1), F.lit(" "))
    blank = lambda c: c.rlike(r"^[\s\u00a0\u2000-\u200a\u202f\u205f\u3000]")
    punct = lambda c: c.rlike(r"^[\p{P}\p{S}]")

    def told(x: Column) -> Column:
        mark = x["raw"].rlike(MARK)
        line = F.substring(x["raw"], 1, 1) == "_"

        def sides(c: Column) -> Column:
            return F.struct(blank(c["a"]).alias("a0"), punct(c["a"]).alias("a1"), blank(c["b"]).alias("b0"), punct(c["b"]).alias("b1"))

        def flanks(c: Column) -> Column:
            left, right = ~c["b0"] & (~c["b1"] | c["a0"] | c["a1"]), ~c["a0"] & (~c["a1"] | c["b0"] | c["b1"])
            return F.struct((left & (~line | ~right | c["a1"])).alias("opens"), (right & (~line | ~left | c["b1"])).alias("closes"))

        can = F.when(mark, _let(F.struct(before(x).alias("a"), after(x).alias("b")), lambda c: _let(sides(c), flanks)))
        no = F.lit(False)
        return _let(can, lambda c: F.struct(x["i"].alias("i"), x["raw"].alias("raw"), F.coalesce(c["opens"], no).alias("opens"), F.coalesce(c["closes"], no).alias("closes"), mark.alias("mark")))

    return t.withColumn("pieces", F.transform(p, told))


def _links(pieces: Column) -> Column:
    """Array of (o, c, img, url): brackets matched by a fold; a link holds no other link."""
    brackets = F.filter(pieces, lambda x: x["raw"].isin("[", "![", "]") | x["raw"].startswith("]("))
    stack_kind, start = "array<struct<i:int,img:boolean,live:boolean>>", f"struct<stack:array<struct<i:int,img:boolean,live:boolean>>,links:{_LINKS}>"

    def step(s: Column, x: Column) -> Column:
        return _let(F.try_element_at(s["stack"], F.lit(-1)), lambda top: after(s, x, top))

    def after(s: Column, x: Column, top: Column) -> Column:
        stack, links = s["stack"], s["links"]
        opens = x["raw"].isin("[", "![")
        some = F.size(stack) > 0
        popped = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
        hit = ~opens & some & x["raw"].startswith("](") & F.coalesce(top["live"], F.lit(False))
        image = F.coalesce(top["img"], F.lit(False))
        url = F.regexp_replace(F.regexp_extract(x["raw"], r"(?s)^\]\(\s*(<[^<>\n]*>|(?:[^\s()<]|\([^\s()]*\))*)", 1), r"^<|>$", "")
        rest = F.when(hit & ~image, F.transform(popped, lambda e: F.struct(e["i"].alias("i"), e["img"].alias("img"), (e["live"] & e["img"]).alias("live")))).otherwise(popped)
        pushed = F.concat(stack, F.array(F.struct(x["i"].alias("i"), (x["raw"] == "![").alias("img"), F.lit(True).alias("live"))))
        new = F.when(opens, pushed).when(some, rest).otherwise(stack)
        found = F.when(hit, F.concat(links, F.array(F.struct(top["i"].alias("o"), x["i"].alias("c"), image.alias("img"), url.alias("url"))))).otherwise(links)
        return F.struct(new.alias("stack"), found.alias("links")).cast(start)

    none = F.struct(F.array().cast(stack_kind).alias("stack"), F.array().cast(_LINKS).alias("links")).cast(start)
    return F.aggregate(brackets, none, step, lambda s: s["links"])


def _pairs(pieces: Column, links: Column) -> Column:
    """Array of (o, c, ch, n): marks matched by a fold over a stack of openers.

    A run of marks is as many steps as it has characters, and each step matches at most once; what is left may open. The last
    opener of the same mark in the same link matches; those above it are dropped. Where a run can open and close, lengths
    that add up to a multiple of three do not match unless both are such. Marks in an image's text are dropped.
    """
    ends = F.transform(links, lambda x: x["c"])
    starts = F.transform(links, lambda x: x["o"])

    def steps_of(x: Column) -> Column:
        n = F.length(x["raw"])
        ch = F.substring(x["raw"], 1, 1)
        link_of = F.get(F.filter(links, lambda e: (e["o"] == x["i"]) | (e["c"] == x["i"])), F.lit(0))
        one = lambda k, last, what, image: F.struct(x["i"].alias("i"), ch.alias("ch"), n.alias("len"), x["opens"].alias("opens"), x["closes"].alias("closes"), (k == 1).alias("first"), last.alias("last"), what.alias("what"), image.alias("image"))
        return F.when(x["mark"], F.transform(F.sequence(F.lit(1), n), lambda k: one(k, k == n, F.lit(0), F.lit(False)))).otherwise(
            F.transform(F.array(link_of), lambda link: one(F.lit(1), F.lit(True), F.when(link["o"] == x["i"], 1).otherwise(2), link["img"]))
        )

    wanted = F.filter(pieces, lambda x: x["mark"] | F.array_contains(starts, x["i"]) | F.array_contains(ends, x["i"]))
    steps = F.flatten(F.transform(wanted, steps_of))

    def mark(s: Column, x: Column) -> Column:
        rem = F.when(x["first"], x["len"]).otherwise(s["rem"])
        here = F.coalesce(F.try_element_at(s["ctx"], F.lit(-1)), F.lit(-1))
        both = x["opens"] & x["closes"]
        apart = lambda e: (e["both"] | both) & ((e["len"] + x["len"]) % 3 == 0) & ~((e["len"] % 3 == 0) & (x["len"] % 3 == 0))
        fits = F.filter(s["stack"], lambda e: (e["ch"] == x["ch"]) & (e["ctx"] == here) & ~apart(e))
        top = F.when(x["closes"] & (rem > 0), F.try_element_at(fits, F.lit(-1)))
        return _let(F.struct(rem.alias("rem"), here.alias("here"), both.alias("both"), top.alias("top")), lambda v: matched(s, x, v))

    def matched(s: Column, x: Column, v: Column) -> Column:
        rem, here, both, top = v["rem"], v["here"], v["both"], v["top"]
        hit = top.isNotNull()
        n = F.when((x["ch"] != "^") & (top["rem"] >= 2) & (rem >= 2), 2).otherwise(1)
        below = F.transform(F.filter(s["stack"], lambda e: e["i"] <= top["i"]), lambda e: F.struct(
            e["i"].alias("i"), e["ch"].alias("ch"), e["len"].alias("len"), F.when(e["i"] == top["i"], e["rem"] - n).otherwise(e["rem"]).alias("rem"), e["both"].alias("both"), e["ctx"].alias("ctx")))
        stack = F.when(hit, F.filter(below, lambda e: e["rem"] > 0)).otherwise(s["stack"])
        left = rem - F.when(hit, n).otherwise(0)
        own = F.struct(x["i"].alias("i"), x["ch"].alias("ch"), x["len"].alias("len"), left.alias("rem"), both.alias("both"), here.alias("ctx"))
        stack = F.when(x["last"] & (left > 0) & x["opens"], F.concat(stack, F.array(own))).otherwise(stack)
        ch = F.when(s["img"] > 0, "").otherwise(x["ch"])
        pairs = F.when(hit, F.concat(s["pairs"], F.array(F.struct(top["i"].alias("o"), x["i"].alias("c"), ch.alias("ch"), n.alias("n"))))).otherwise(s["pairs"])
        return F.struct(stack.alias("stack"), left.alias("rem"), pairs.alias("pairs"), s["ctx"].alias("ctx"), s["img"].alias("img")).cast(_STATE)

    def bracket(s: Column, x: Column) -> Column:
        enter = x["what"] == 1
        here = F.try_element_at(s["ctx"], F.lit(-1))
        ctx = F.when(enter, F.concat(s["ctx"], F.array(x["i"]))).otherwise(F.slice(s["ctx"], 1, F.greatest(F.size(s["ctx"]) - 1, F.lit(0))))
        stack = F.when(enter, s["stack"]).otherwise(F.filter(s["stack"], lambda e: e["ctx"] != here))
        img = s["img"] + F.when(x["image"], F.when(enter, 1).otherwise(-1)).otherwise(0)
        return F.struct(stack.alias("stack"), F.lit(0).alias("rem"), s["pairs"].alias("pairs"), ctx.alias("ctx"), img.alias("img")).cast(_STATE)

    none = F.struct(F.array().alias("stack"), F.lit(0).alias("rem"), F.array().alias("pairs"), F.array().alias("ctx"), F.lit(0).alias("img")).cast(_STATE)
    return F.aggregate(steps, none, lambda s, x: F.when(x["what"] == 0, mark(s, x)).otherwise(bracket(s, x)), lambda s: s["pairs"])


def md_inline(blocks: DataFrame, keys: tuple[str, ...] = ("doc_id", "block_no")) -> DataFrame:
    """(keys, run_no, kind, text, bold, italic, strike, sub, sup, underline, url): the runs of each block's text, styles nested.

    kind is text, code, math, break, autolink or html. Text in a link is underlined and has its url; an image is [alt](url) as
    text, without styles of its own. A line feed is a space, one after two spaces or a backslash a break. Escaped characters
    and characters by name are read; marks and brackets without a partner stay. Neighbours that look alike are one run.
    A null text gives no rows.
    """
    t = _flanks(blocks.select(*keys, _pieces(F.col("text")).alias("pieces")))
    t = t.withColumn("links", _links(F.col("pieces")))
    t = t.withColumn("pairs", _pairs(F.col("pieces"), F.col("links")))
    event = "struct<i:int,seq:int,raw:string,style:string,d:int,url:string>"
    name = lambda p: F.coalesce(*[F.when((p["ch"] == ch) & (p["n"] == n), s) for (ch, n), s in PAIRED.items()], F.lit(""))
    make = lambda i, seq, raw, style, d, url: F.struct(i.alias("i"), seq.alias("seq"), raw.alias("raw"), style.alias("style"), d.alias("d"), url.alias("url")).cast(event)
    no = F.lit(None).cast("string")
    words = F.transform("pieces", lambda x: make(x["i"], F.lit(1), x["raw"], F.when(x["mark"], "mark").otherwise(""), F.lit(0), no))
    marks = F.flatten(F.transform("pairs", lambda p: F.array(make(p["o"], F.lit(2), no, name(p), F.lit(1), no), make(p["c"], F.lit(0), no, name(p), F.lit(-1), no), make(p["o"], F.lit(1), no, F.lit("used"), p["n"], no), make(p["c"], F.lit(1), no, F.lit("used"), p["n"], no))))
    kind = lambda x: F.when(x["img"], "image").otherwise("link")
    ties = F.flatten(F.transform("links", lambda x: F.array(make(x["o"], F.lit(2), no, kind(x), F.lit(1), x["url"]), make(x["c"], F.lit(0), no, kind(x), F.lit(-1), x["url"]), make(x["o"], F.lit(1), no, F.concat(F.lit("o"), kind(x)), F.lit(0), x["url"]), make(x["c"], F.lit(1), no, F.concat(F.lit("c"), kind(x)), F.lit(0), x["url"]))))
    e = t.select(*keys, F.explode(F.concat(words, marks, ties)).alias("e")).select(*keys, "e.*")
    place = W.partitionBy(*keys, "i", "seq")
    e = e.withColumns({"used": F.sum(F.when(F.col("style") == "used", F.col("d"))).over(place), "tied": F.max(F.when(F.col("style").isin("olink", "clink", "oimage", "cimage"), F.col("style"))).over(place), "target": F.max(F.when(F.col("style") == "cimage", F.col("url"))).over(place)})
    e = e.filter("style NOT IN ('used', 'olink', 'clink', 'oimage', 'cimage')")
    run = W.partitionBy(*keys).orderBy("i", "seq", F.desc("d"), "style").rowsBetween(W.unboundedPreceding, W.currentRow)
    depth = {s: F.sum(F.when(F.col("style") == s, F.col("d")).otherwise(0)).over(run) for s in (*TEXT_STYLES, "link")}
    e = e.withColumns(depth | {"href": F.last(F.when((F.col("style") == "link") & (F.col("d") == 1), F.col("url")), ignorenulls=True).over(run)}).filter("seq = 1")
    raw = F.col("raw")
    whole = lambda rx: raw.rlike("(?s)^" + rx + "$")
    plain = F.col("style") == ""
    what = (
        F.when(~plain, "text").when(whole(r"(?: {2,}|\\)\n *"), "break").when(whole(r"(`+).+\1"), "code").when(whole(r"\$.+\$"), "math").when(whole(r"<(?:[A-Za-z][A-Za-z0-9+.\-]{1,31}:[^\s<>]*|[^\s<>@/]+@[^\s<>@]+)>"), "autolink")
        .when(whole(r"<.+>"), "html").otherwise("text")
    )
    code = F.regexp_replace(F.regexp_replace(raw, "^`+|`+$", ""), "\n", " ")
    padded = code.rlike(r"(?s)^ .* $") & code.rlike(r"[^ ]")
    text = (
        F.when(F.col("tied").isin("olink", "clink"), "").when(F.col("tied") == "oimage", "[").when(F.col("tied") == "cimage", F.concat(F.lit("]("), F.col("target"), F.lit(")")))
        .when(~plain, F.substr(raw, F.lit(1), F.length(raw) - F.coalesce("used", F.lit(0)))).when(what == "break", "\n").when(what == "code", F.when(padded, F.substr(code, F.lit(2), F.length(code) - 2)).otherwise(code))
        .when(what.isin("math", "autolink"), F.substr(raw, F.lit(2), F.length(raw) - 2)).when(what == "html", raw).when(whole(r" ?\n *"), " ").when(whole(r"\\[!-/:-@\[-`{-~]"), F.substring(raw, 2, 1))
        .when(raw.rlike(r"^&[#A-Za-z]\w*;|^&#\d+;$"), decode_entities(raw)).otherwise(raw)
    )
    linked = F.col("link") > 0
    e = e.select(*keys, "i", what.alias("kind"), text.alias("text"), *[(F.col(s) > 0).alias(s) for s in TEXT_STYLES], (linked | (what == "autolink")).alias("underline"), F.when(linked, F.col("href")).when(what == "autolink", text).alias("url")).filter("text <> ''")
    own = W.partitionBy(*keys).orderBy("i")
    same = F.col("kind") == "text"
    for c in ("kind", *TEXT_STYLES, "underline", "url"):
        same = same & F.lag(c).over(own).eqNullSafe(F.col(c))
    e = e.withColumn("run", F.sum(F.when(same, 0).otherwise(1)).over(own.rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = e.groupBy(*keys, "run").agg(*[F.first(c).alias(c) for c in ("kind", *TEXT_STYLES, "underline", "url")], F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "").alias("text"))
    return rows.select(*keys, (F.col("run") - 1).cast("int").alias("run_no"), "kind", "text", *TEXT_STYLES, "underline", "url")
