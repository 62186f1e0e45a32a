"""Page geometry, pagination, numbering and history: ordered work by windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import resolve_tokens
from .text import numbered

#: Paper sizes in millimetres, upright.
PAPERS = {
    "A0": (841, 1189), "A1": (594, 841), "A2": (420, 594), "A3": (297, 420), "A4": (210, 297), "A5": (148, 210), "A6": (105, 148), "A7": (74, 105),
    "B4_ISO": (250, 353), "B5_ISO": (176, 250), "B6_ISO": (125, 176), "B4_JIS": (257, 364), "B5_JIS": (182, 257), "B6_JIS": (128, 182),
    "Letter": (215.9, 279.4), "Legal": (215.9, 355.6), "Ledger": (431.8, 279.4), "Tabloid": (279.4, 431.8), "Statement": (139.7, 215.9),
    "Executive": (184.2, 266.7), "Folio": (215.9, 330.2), "Broadsheet": (381, 585), "Berliner": (315, 470), "Compact": (282, 380),
    "KoreanBroadsheet": (393, 546), "SinGukPan": (152, 225), "GukPan": (148, 210), "Pan46Bae": (188, 257), "CrownPan": (176, 248),
    "Pan46": (127, 188), "MassMarket": (106, 175), "BookRoyal": (156, 234), "BookDemy": (138, 216), "BookTrade": (152, 229),
    "BookQuarto": (189, 246), "BookLargeFormat": (216, 280),
}
#: The default outline style by level: size pt, bold, italic, space before and after pt, line height.
OUTLINE = {
    0: (11.0, False, False, 0.0, 0.0, 1.6), 1: (24.0, True, False, 12.0, 6.0, 1.3), 2: (20.0, True, False, 10.0, 4.0, 1.3), 3: (17.0, True, False, 8.0, 4.0, 1.3),
    4: (15.0, True, False, 6.0, 2.0, 1.2), 5: (13.0, True, False, 4.0, 2.0, 1.2), 6: (12.0, True, True, 4.0, 2.0, 1.2),
}
#: Standard border widths in millimetres.
WIDTHS = (0.1, 0.12, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 1.0, 1.5, 2.0, 3.0, 4.0, 5.0)


def page_geometry(sections: DataFrame) -> DataFrame:
    """A row per column of each section (id, paper, landscape, margins in mm, columns, gap): widths and offsets in DIP."""
    spark = sections.sparkSession
    papers = spark.createDataFrame([(k, float(w), float(h)) for k, (w, h) in PAPERS.items()], "paper string, w double, h double")
    s = sections.join(F.broadcast(papers), "paper")  # 36 rows
    dip = lambda mm: mm * 96.0 / 25.4
    width, height = F.when(F.col("landscape"), F.col("h")).otherwise(F.col("w")), F.when(F.col("landscape"), F.col("w")).otherwise(F.col("h"))
    body = F.greatest(F.lit(1.0), dip(width) - 2 * dip(F.col("margin")))
    gap = F.when(F.col("columns") > 1, dip(F.col("gap"))).otherwise(0.0)
    column = F.when(F.col("columns") > 1, F.greatest(F.lit(10.0), (body - gap * (F.col("columns") - 1)) / F.col("columns"))).otherwise(body)
    s = s.withColumns({"page_w": dip(width), "page_h": dip(height), "column_w": column, "gap_w": gap}).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)))
    return s.select("id", "paper", "k", F.round("page_w", 4).alias("page_w"), F.round("page_h", 4).alias("page_h"), F.round("column_w", 4).alias("column_w"), F.round(F.col("k") * (F.col("column_w") + F.col("gap_w")), 4).alias("x"))


def apply_outline_style(blocks: DataFrame) -> DataFrame:
    """blocks (level, and any of size_pt, bold, italic, before, after, line_height where set directly) with the style of their
    level: a direct value wins, then the level's, then the plain text's."""
    spark = blocks.sparkSession
    rows = [(k, *v) for k, v in OUTLINE.items()]
    names = ("size_pt", "bold", "italic", "before", "after", "line_height")
    preset = spark.createDataFrame(rows, "level int, _size_pt double, _bold boolean, _italic boolean, _before double, _after double, _line_height double")
    out = blocks.join(F.broadcast(preset), "level", "left")  # 7 rows
    plain = dict(zip(names, OUTLINE.get(0, (11.0, False, False, 0.0, 0.0, 1.0)), strict=False))
    for c in names:
        given = [F.col(c)] if c in blocks.columns else []
        out = out.withColumn(c, F.coalesce(*given, F.col(f"_{c}"), F.lit(plain[c])))
    return out.drop(*(f"_{c}" for c in names))


def snap_to_standard(values: DataFrame, points: str = "pt") -> DataFrame:
    """values with the nearest standard width in mm; the first of equally near ones; 0.12 for none."""
    mm = F.col(points) * 0.3527777778
    best = F.array_min(F.array(*[F.struct(F.abs(F.lit(w) - mm).alias("d"), F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in enumerate(WIDTHS)]))
    return values.withColumn("mm", F.when(F.col(points) <= 0, 0.12).otherwise(best["w"]))


def block_heights(blocks: DataFrame, chars_per_line: int = 80, line: int = 1800) -> DataFrame:
    """blocks with a height in hundredths of DIP, by characters per line."""
    return blocks.withColumn("height", F.greatest(F.lit(1), F.ceil(F.length("text") / chars_per_line)).cast("long") * line)


def paginate_natural(blocks: DataFrame, body: int, columns: int = 1) -> DataFrame:
    """blocks (doc_id, pos, height, forced) with page and col.

    A block's slot is its top over the body's height. A forced break, other than on a first block, goes to the first
    column of the page after the one before it, or further if its own top does, and holds what follows back as well: its
    page is the running maximum of pages due, each break adding one.
    """
    w = W.partitionBy("doc_id").orderBy("pos")
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    b = blocks.withColumn("nat", F.floor((F.sum("height").over(so_far) - F.col("height")) / body)).withColumn("prev", F.lag("nat").over(w))
    forced = F.col("forced") & F.col("prev").isNotNull()
    b = b.withColumn("brk", forced).withColumn("j", F.sum(F.col("brk").cast("int")).over(so_far))
    due = F.when(F.col("brk"), F.greatest(F.floor(F.col("nat") / columns), F.floor(F.col("prev") / columns) + 1) - F.col("j"))
    b = b.withColumn("floor_page", F.max(due).over(so_far) + F.col("j"))
    at_break = F.when(F.col("brk"), F.greatest(F.col("nat"), F.col("floor_page") * columns))
    b = b.withColumn("least", F.last(at_break, ignorenulls=True).over(so_far))
    slot = F.greatest(F.col("nat"), F.coalesce("least", F.lit(0).cast("long")))
    return b.withColumn("slot", slot).select("doc_id", "pos", F.floor(F.col("slot") / columns).cast("long").alias("page"), (F.col("slot") % columns).cast("long").alias("col"))


def outline_numbers(headings: DataFrame, levels: int = 3) -> DataFrame:
    """headings (doc_id, pos, level) with their hierarchical number, as 2.1.3; a level restarts below a higher heading."""
    out = headings
    so_far = lambda *keys: W.partitionBy("doc_id", *keys).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    for k in range(1, levels + 1):
        out = out.withColumn(f"g{k}", F.sum((F.col("level") < k).cast("int")).over(so_far()))
        out = out.withColumn(f"n{k}", F.sum((F.col("level") == k).cast("int")).over(so_far(f"g{k}")))
    text = F.array_join(F.slice(F.array(*[F.col(f"n{k}").cast("string") for k in range(1, levels + 1)]), F.lit(1), F.col("level")), ".")
    return out.withColumn("number", text).drop(*[f"{c}{k}" for c in "gn" for k in range(1, levels + 1)])


def split_overlay(blocks: DataFrame) -> DataFrame:
    """blocks (kind, wrap) with overlay: text boxes always float, tables unless they wrap as blocks, images and shapes by wrap."""
    kind, wrap = F.col("kind"), F.col("wrap")
    return blocks.withColumn("overlay", (kind == "textbox") | ((kind == "table") & (wrap != "block")) | (kind.isin("image", "shape") & wrap.isin("front", "behind", "square")))


def page_headers(pages: DataFrame, templates: list[tuple[str, str, str]], start: int = 1) -> DataFrame:
    """(doc_id, page, part, slot, text): each page's header and footer slots with tokens filled in; empty ones are skipped.

    pages (doc_id, page from 0, pages, title); templates (part, slot, template). Page numbers begin at start.
    """
    slots = F.array(*[F.struct(F.lit(a).alias("part"), F.lit(b).alias("slot"), F.lit(t).alias("template")) for a, b, t in templates if t])
    p = pages.withColumn("s", F.explode(slots))
    text = resolve_tokens(F.col("s.template"), page=F.col("page") + start, pages=F.col("pages"), title=F.col("title"))
    return p.select("doc_id", "page", "s.part", "s.slot", text.alias("text"))


def snapshot_history(versions: DataFrame, depth: int = 100) -> DataFrame:
    """versions (key, id, ts) that undo can reach, the newest first, with the ones before and after."""
    w = W.partitionBy("key").orderBy("ts", "id")
    v = versions.withColumns({"undo": F.lag("id").over(w), "redo": F.lead("id").over(w), "age": F.row_number().over(W.partitionBy("key").orderBy(F.desc("ts"), F.desc("id")))})
    return v.filter(F.col("age") <= depth).select("key", "id", "age", "undo", "redo")


def intern_styles(rows: DataFrame, keys: list[str], order: list[str], default: dict | None = None, digits: int = 2) -> DataFrame:
    """(keys, style_id, uses): an id for each combination, by first appearance from 1; the default one is 0.

    Keys that are numbers are rounded to some digits first, so that what prints alike is one style.
    """
    numbers = {f.name for f in rows.schema.fields if f.dataType.typeName() in ("double", "float", "decimal")}
    rows = rows.withColumns({k: F.round(F.col(k).cast("double"), digits) for k in keys if k in numbers})
    first = rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"), F.count("*").alias("uses"))
    plain = F.lit(False)
    if default is not None:
        plain = F.lit(True)
        for k in keys:
            plain = plain & F.col(k).eqNullSafe(F.lit(default.get(k)))
    first = first.withColumn("_plain", plain)
    others = numbered(first.filter("NOT _plain"), ["_first", *keys], "style_id")
    return others.unionByName(first.filter("_plain").withColumn("style_id", F.lit(0).cast("long"))).drop("_first", "_plain")


def page_coordinates(items: DataFrame, height: float, gap: float = 10.0) -> DataFrame:
    """items (page, y in mm) with their continuous y in DIP and back: page and y, clamped to the page's end."""
    y = F.col("page") * (height + gap) + F.col("y_mm") * 96.0 / 25.4
    out = items.withColumn("y_dip", y)
    page = F.floor(F.col("y_dip") / (height + gap))
    inside = F.least(F.col("y_dip") - page * (height + gap), F.lit(height))
    return out.withColumns({"back_page": page, "back_y_mm": F.round(inside * 25.4 / 96.0, 6), "y_dip": F.round("y_dip", 6)})


def edit_bursts(events: DataFrame, gap_seconds: float) -> DataFrame:
    """(key, burst, started, n): runs of edits less than a gap apart, that no other action of the key interrupts.

    events (key, id, ts) and, where there are other actions, edit: whether an event is an edit.
    """
    e = events if "edit" in events.columns else events.withColumn("edit", F.lit(True))
    w = W.partitionBy("key").orderBy("ts", "id")
    goes_on = F.lag("edit").over(w) & (F.col("ts") - F.lag("ts").over(w) < F.expr(f"INTERVAL {gap_seconds} SECOND"))
    e = e.withColumn("new", F.when(F.col("edit"), F.coalesce(~goes_on, F.lit(True)).cast("int")).otherwise(0))
    e = e.withColumn("burst", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).filter("edit")
    return e.groupBy("key", "burst").agg(F.min("ts").alias("started"), F.count("*").alias("n"))


def paginate(blocks: DataFrame, body: int, columns: int = 1, tolerance: int = 200, most_blocks: int = 2500) -> DataFrame:
    """blocks (doc_id, pos, height, forced) with page and col, as paginate_natural and with pushes, a block as a whole.

    A block that would cross its slot's end, or for which its slot has no room left, goes on to the next slot that has;
    one as high as a page is never pushed. The state of the fold is the fill of each slot. A document of more than
    most_blocks blocks is degraded: all of it is on page 0. Heights are whole numbers.
    """
    counted = blocks.groupBy("doc_id").agg(F.count("*").alias("n"))
    every = blocks.join(counted, "doc_id")
    plain = every.filter(F.col("n") > most_blocks).select("doc_id", "pos", F.lit(0).cast("long").alias("page"), F.lit(0).cast("long").alias("col"))
    tops = F.sum("height").over(W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("height")
    rows = every.filter(F.col("n") <= most_blocks).withColumn("top", tops)
    rows = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), F.col("top").cast("long").alias("top"), F.col("height").cast("long").alias("h"), "forced"))).alias("b"))
    start = F.expr("named_struct('prev', -1L, 'least', 0L, 'fill', cast(map() as map<bigint,bigint>), 'out', cast(array() as array<bigint>))")

    def room(s, k):
        return F.coalesce(F.element_at(s["fill"], k), F.lit(0).cast("long"))

    def step(s, x):
        natural = F.greatest(s["least"], F.floor(x["top"] / body))
        breaks = x["forced"] & (s["prev"] >= 0)
        due = F.when(breaks, F.greatest(natural, (F.floor(s["prev"] / columns) + 1) * columns)).otherwise(natural)
        small = x["h"] < body
        crossed = F.when(~breaks & small & (x["top"] + x["h"] > (due + 1) * body + tolerance), due + 1).otherwise(due)

        def place(at):
            free = F.filter(F.sequence(at, at + F.size(s["fill"]) + 1), lambda k: room(s, k) + x["h"] <= body + tolerance)
            slot = F.when(small & (x["h"] > 0), F.element_at(free, 1)).otherwise(at)
            return F.struct(slot.alias("slot"), F.when(breaks, due).otherwise(s["least"]).alias("least"))

        found = F.element_at(F.transform(F.array(crossed), place), 1)

        def update(p):
            full = F.least(F.lit(body).cast("long"), room(s, p["slot"]) + F.least(x["h"], F.lit(body).cast("long")))
            fill = F.map_concat(F.map_filter(s["fill"], lambda k, v: k != p["slot"]), F.create_map(p["slot"], full))
            return F.struct(p["slot"].alias("prev"), p["least"].alias("least"), fill.alias("fill"), F.concat(s["out"], F.array(p["slot"])).alias("out"))

        return F.element_at(F.transform(F.array(found), update), 1)

    placed = rows.select("doc_id", "b", F.aggregate("b", start, step)["out"].alias("slots"))
    one = placed.select("doc_id", F.explode(F.arrays_zip(F.transform("b", lambda x: x["pos"]).alias("pos"), "slots")).alias("z"))
    pos, slot = F.col("z")["pos"], F.col("z")["slots"]
    return one.select("doc_id", pos.alias("pos"), F.floor(slot / columns).cast("long").alias("page"), (slot % columns).cast("long").alias("col")).unionByName(plain)
