"""Which files are taken in, how they are decoded, and whether they are intact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import extension

#: How each extension is handled.
ROUTES = {
    "iwpf": "native", "md": "native", "markdown": "native", "txt": "native",
    "html": "external", "htm": "external", "xml": "external", "xhtml": "external",
    "docx": "external", "hwpx": "external", "hwp": "external", "doc": "external",
}
#: File names with a converter of their own.
CONVERTERS = {"html": "html", "htm": "html", "xml": "xml", "xhtml": "xml", "docx": "docx", "hwpx": "hwpx"}
#: Markers of HTML in the first 2048 characters, besides the document type, namespace, html and body.
XHTML_MARKERS = (
    "<h1", "<h2", "<h3", "<h4", "<h5", "<h6", "<p>", "<p ", "<div", "<ul>", "<ul ", "<ol>", "<ol ", "<li>", "<li ",
    "<table", "<thead", "<tbody", "<tr>", "<tr ", "<td>", "<td ", "<th>", "<th ", "<blockquote", "<pre>", "<pre ",
    "<code>", "<code ", "<a href", "<img ", "<img/>", "<br/>", "<br>", "<hr/>", "<hr>", "<strong>", "<em>", "<span",
    "<figure", "<section", "<article",
)


def _lookup(key, values: dict[str, str], default: str) -> F.Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def format_route(files: DataFrame, path: str = "path") -> DataFrame:
    """files with ext and route: native, external (through a converter) or unsupported."""
    ext = extension(F.col(path))
    return files.withColumn("ext", ext).withColumn("route", _lookup(F.col("ext"), ROUTES, "unsupported"))


def route_counts(files: DataFrame, path: str = "path") -> DataFrame:
    return format_route(files, path).groupBy("ext", "route").agg(F.count("*").alias("n"))


def looks_binary(content) -> F.Column:
    """More than one byte in twenty of the first 1024 is NUL."""
    head = F.substring(content, 1, 1024)
    others = F.replace(F.regexp_replace(F.hex(head), "(..)", "$1,"), F.lit("00,"), F.lit(""))
    return (F.length(head) - F.length(others) / 3) * 20 > F.length(head)


def binary_reject(files: DataFrame, content: str = "content") -> DataFrame:
    """files with rejected: whether the content looks binary; null or empty content does not."""
    return files.withColumn("rejected", F.coalesce(looks_binary(F.col(content)), F.lit(False)))


#: Declared names and the character sets that decode them; other names are read as UTF-8.
CHARSETS = {
    "utf-8": "UTF-8", "utf8": "UTF-8", "us-ascii": "US-ASCII", "ascii": "US-ASCII", "iso-8859-1": "ISO-8859-1", "latin1": "ISO-8859-1", "utf-16": "UTF-16BE", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE",
    "euc-kr": "EUC-KR", "ks_c_5601-1987": "x-windows-949", "cp949": "x-windows-949", "windows-949": "x-windows-949", "uhc": "x-windows-949", "iso-2022-kr": "ISO-2022-KR",
    "shift_jis": "Shift_JIS", "sjis": "Shift_JIS", "windows-31j": "windows-31j", "euc-jp": "EUC-JP", "iso-2022-jp": "ISO-2022-JP",
    "gb2312": "GB2312", "gbk": "GBK", "gb18030": "GB18030", "big5": "Big5", "koi8-r": "KOI8-R", "koi8-u": "KOI8-U", "macintosh": "x-MacRoman", "ibm866": "IBM866",
    **{f"windows-{n}": f"windows-{n}" for n in range(1250, 1259)}, **{f"iso-8859-{n}": f"ISO-8859-{n}" for n in (2, 3, 4, 5, 6, 7, 8, 9, 13, 15)},
}
def detect_encoding(files: DataFrame, content: str = "content", kind: str = "html") -> DataFrame:
    """files with encoding and decoded text: by byte order mark, then the declaration in the head, else UTF-8."""
    raw = F.col(content)
    mark = F.hex(F.substring(raw, 1, 4))
    head = F.decode(F.substring(raw, 1, 4096 if kind == "html" else 256), "ISO-8859-1")
    said = F.lower(F.regexp_extract(head, r"(?i)<meta[^>]+charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)" if kind == "html" else r"(?i)<\?xml[^>]*encoding\s*=\s*[\"']([A-Za-z0-9_:.-]+)", 1))
    names = {k: k if k not in ("utf8", "latin1", "ascii") else v.lower() for k, v in CHARSETS.items()}
    enc = (
        F.when(mark.startswith("EFBBBF"), "utf-8-bom").when(mark.startswith("FFFE"), "utf-16le-bom").when(mark.startswith("FEFF"), "utf-16be-bom")
        .otherwise(_lookup(said, names, "utf-8"))
    )
    out = files.withColumn("encoding", enc)
    e = F.col("encoding")
    text = F.when(e == "utf-8-bom", F.decode(F.substring(raw, 4, 2147483647), "UTF-8"))
    for bom, charset in (("utf-16le-bom", "UTF-16LE"), ("utf-16be-bom", "UTF-16BE")):
        text = text.when(e == bom, F.decode(F.substring(raw, 3, 2147483647), charset))
    spark = files.sparkSession
    setting = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")  # read when the expression is made: other character sets than the few of the standard
    try:
        for charset in dict.fromkeys(CHARSETS.values()):
            own = [k for k, v in names.items() if CHARSETS[k] == charset]
            text = text.when(e.isin(*own, *(names[k] for k in own)), F.decode(raw, "ISO-8859-1" if charset == "US-ASCII" else charset))
        return out.withColumn("text", text.otherwise(F.decode(raw, "UTF-8")))
    finally:
        spark.conf.set(setting, before)


def sniff_xhtml(docs: DataFrame, content: str = "content") -> DataFrame:
    """docs with route: html if the first 2048 characters hold an HTML marker, else xml."""
    head = F.lower(F.substring(content, 1, 2048))
    marks = ("<!doctype html", 'xmlns="http://www.w3.org/1999/xhtml"', "<html", "<body", *XHTML_MARKERS)
    hit = F.lit(False)
    for m in marks:
        hit = hit | head.contains(m)
    return docs.withColumn("route", F.when(hit, "html").otherwise("xml"))


def build_manifest(parts: DataFrame) -> DataFrame:
    """(pkg, path, media_type, size, sha256) of package parts (pkg, path, media_type, content)."""
    return parts.select("pkg", "path", "media_type", F.octet_length("content").cast("long").alias("size"), F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))


def verify_manifest(parts: DataFrame, manifest: DataFrame, verify: bool = True) -> DataFrame:
    """(pkg, path, status) of every manifest entry: ok, tampered or missing; parts without an entry are not checked."""
    own = parts.select("pkg", "path", (F.sha2(F.col("content").cast("binary"), 256) if verify else F.lit(None).cast("string")).alias("_found"), F.lit(True).alias("_there"))
    status = F.when(F.col("_there").isNull(), "missing").when(F.lit(verify) & (F.col("_found") != F.lower("sha256")), "tampered").otherwise("ok")
    return manifest.join(own, ["pkg", "path"], "left").select("pkg", "path", status.alias("status"))


def safe_output_names(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, target) for wanted (id, name, ext): name.ext, or the first free name-1.ext, name-2.ext, ...

    Free numbers are found per name by one window over the wanted rows and the numbers that existing files (name, ext)
    use up, so the work grows with the rows of a name, not with their pairs.
    """
    rx = r"^(.*)-([1-9][0-9]{0,17})$"
    numbered = existing.select(F.regexp_extract("name", rx, 1).alias("name"), "ext", F.regexp_extract("name", rx, 2).try_cast("long").alias("k"))
    taken = existing.select("name", "ext", F.lit(0).cast("long").alias("k")).unionByName(numbered.filter(F.col("k").isNotNull() & (F.col("name") != ""))).distinct()
    # the n-th free number of a name is n-1 plus the used numbers before it: used numbers k_j shift ranks past k_j - j
    own = W.partitionBy("name", "ext")
    steps = taken.select("name", "ext", (F.col("k") - F.row_number().over(own.orderBy("k")) + 1).alias("at"), F.lit(0).alias("asked"), F.lit(None).alias("id"))
    ranked = wanted.select("name", "ext", (F.row_number().over(own.orderBy("id")) - 1).cast("long").alias("at"), F.lit(1).alias("asked"), "id")
    used = F.sum(1 - F.col("asked")).over(own.orderBy("at", "asked").rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = steps.withColumn("id", F.col("id").cast(ranked.schema["id"].dataType)).unionByName(ranked).withColumn("k", F.col("at") + used).filter("asked = 1")
    return placed.select("id", F.concat("name", F.when(F.col("k") > 0, F.concat(F.lit("-"), F.col("k").cast("string"))).otherwise(""), F.lit("."), "ext").alias("target"))


def seal_parts(parts: DataFrame, key: bytes) -> DataFrame:
    """content of each part under authenticated encryption; key of 16, 24 or 32 bytes."""
    return parts.withColumn("content", F.aes_encrypt("content", F.lit(key), F.lit("GCM")))


def unseal_parts(parts: DataFrame, key: bytes) -> DataFrame:
    """The inverse; status tells ok or wrong-key, with null content."""
    opened = parts.withColumn("content", F.try_aes_decrypt("content", F.lit(key), F.lit("GCM")))
    return opened.withColumn("status", F.when(F.col("content").isNull(), "wrong-key").otherwise("ok"))


def derive_key(password: str, salt: bytes, rounds: int = 200_000) -> bytes:
    import hashlib

    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds, 32)
