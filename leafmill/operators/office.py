"""Tables, images and unknown elements of word-processing parts, and border specifications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import decode_entities, twips_to_mm
from .layout import snap_to_standard
from .text import numbered

#: Elements that the paragraph, table and image jobs read.
KNOWN = ("w:document", "w:body", "w:p", "w:pPr", "w:pStyle", "w:outlineLvl", "w:r", "w:rPr", "w:t", "w:br", "w:tbl", "w:tblPr", "w:tr", "w:trPr", "w:tc", "w:tcPr", "w:tcW", "w:gridSpan", "w:vMerge", "w:tblHeader", "w:drawing", "a:blip", "w:sectPr")


def _each(element: str) -> F.Column:
    return F.lit(rf"(?s)<{element}(?:\s[^>]*)?>.*?</{element}>")


def office_tables(parts: DataFrame) -> DataFrame:
    """(pkg, table_no, row_no, cell_no, is_header, col_span, width_mm, text): cells of flat tables of (pkg, content)."""
    t = parts.select("pkg", F.posexplode(F.regexp_extract_all("content", _each("w:tbl"), F.lit(0))).alias("table_no", "x"))
    r = t.select("pkg", "table_no", F.posexplode(F.regexp_extract_all("x", _each("w:tr"), F.lit(0))).alias("row_no", "x"))
    c = r.select("pkg", "table_no", "row_no", F.col("x").contains("<w:tblHeader/>").alias("is_header"), F.posexplode(F.regexp_extract_all("x", _each("w:tc"), F.lit(0))).alias("cell_no", "x"))
    number = lambda rx: F.regexp_extract("x", rx, 1).try_cast("double")
    text = F.array_join(F.regexp_extract_all("x", F.lit(r"(?s)<w:t(?:\s[^>]*)?>(.*?)</w:t>"), F.lit(1)), "")
    return c.select("pkg", "table_no", "row_no", "cell_no", "is_header", F.coalesce(number(r'<w:gridSpan w:val="(\d+)"').cast("int"), F.lit(1)).alias("col_span"), F.round(twips_to_mm(number(r'<w:tcW w:w="(\d+)"')), 3).alias("width_mm"), decode_entities(text).alias("text"))


def office_images(parts: DataFrame) -> DataFrame:
    """(pkg, pos, path, size, sha256): pictures of word/document.xml by their relationship; null where there is no part."""
    ref = parts.filter("path = 'word/document.xml'").select("pkg", F.posexplode(F.regexp_extract_all("content", F.lit(r'<a:blip [^>]*r:embed="([^"]*)"'), F.lit(1))).alias("pos", "rid"))
    rels = parts.filter("path = 'word/_rels/document.xml.rels'").select("pkg", F.explode(F.regexp_extract_all("content", F.lit("<Relationship [^>]*/>"), F.lit(0))).alias("x"))
    rels = rels.select("pkg", F.regexp_extract("x", r'\bId="([^"]*)"', 1).alias("rid"), F.concat(F.lit("word/"), F.regexp_extract("x", r'Target="([^"]*)"', 1)).alias("path"))
    own = parts.select("pkg", "path", F.octet_length("content").alias("size"), F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))
    return ref.join(rels, ["pkg", "rid"], "left").join(own, ["pkg", "path"], "left").select("pkg", "pos", "path", "size", "sha256")


def opaque_islands(parts: DataFrame) -> DataFrame:
    """(pkg, kind, n, label): elements that no job reads, counted by kind."""
    known = parts.sparkSession.createDataFrame([(k,) for k in KNOWN], "kind string")
    t = parts.select("pkg", F.explode(F.regexp_extract_all("content", F.lit(r"<([A-Za-z0-9]+:[A-Za-z0-9]+)\b"), F.lit(1))).alias("kind"))
    out = t.groupBy("pkg", "kind").agg(F.count("*").alias("n")).join(F.broadcast(known), "kind", "left_anti")  # a fixed list
    return out.select("pkg", "kind", "n", F.concat(F.lit("["), "kind", F.lit("]")).alias("label"))


SIDES = ("left", "right", "top", "bottom")


def intern_border_fills(cells: DataFrame, order: str) -> DataFrame:
    """(left_mm, ..., bottom_mm, fill, uses, fill_id): ids from 4 of each set of four border widths (left_pt, ..., bottom_pt),
    snapped to standard ones, and fill, by first appearance."""
    s = cells
    for side in SIDES:
        s = snap_to_standard(s, f"{side}_pt").withColumnRenamed("mm", f"{side}_mm")
    keys = [*(f"{side}_mm" for side in SIDES), "fill"]
    first = s.groupBy(*keys).agg(F.min(order).alias("_first"), F.count("*").alias("uses"))
    return numbered(first, ["_first", *keys], "fill_id", 4).drop("_first")


def zip_parts(packages: DataFrame) -> DataFrame:
    """(path, content): ZIP files of (path, parts), parts an array of (path, content)."""

    def pack(batches):
        import io
        import zipfile

        import pandas as pd

        for b in batches:
            rows = []
            for path, parts in zip(b["path"], b["parts"], strict=True):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    for p in parts:
                        z.writestr(p["path"], bytes(p["content"]))
                rows.append((path, out.getvalue()))
            yield pd.DataFrame(rows, columns=["path", "content"])

    return packages.select("path", "parts").mapInPandas(pack, "path string, content binary")


#: Bytes of a part up to which its content is read.
MOST_PART = 256 << 20


def package_parts(files: DataFrame, most: int = MOST_PART) -> DataFrame:
    """(pkg, path, size, content) of the parts of ZIP packages (path, content), a row at a time.

    A broken package gives no rows. A part of more than `most` bytes has its size and null content, so that a small file
    that unpacks to very much stays harmless.
    """

    def unzip(batches):
        import io
        import zipfile

        import pandas as pd

        names = ["pkg", "path", "size", "content"]
        for b in batches:
            rows, held = [], 0
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for i in z.infolist():
                            if not i.is_dir():
                                data = z.read(i) if i.file_size <= most else None
                                rows.append((path, i.filename, i.file_size, data))
                                held += len(data or b"")
                            if held > 16 << 20:
                                yield pd.DataFrame(rows, columns=names)
                                rows, held = [], 0
                except (zipfile.BadZipFile, TypeError):
                    continue
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(unzip, "pkg string, path string, size long, content binary")
