"""Column expressions: escapes, units, colours, numbers, tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

#: Media types by extension, and back.
MEDIA_TYPES = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp",
    "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp", "svg": "image/svg+xml",
}
EXTENSIONS = {
    "image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/bmp": ".bmp", "image/tiff": ".tif",
    "image/svg+xml": ".svg", "image/webp": ".webp",
}
#: Header and footer tokens and their Korean names.
TOKENS = {
    "page": ("PAGE", "페이지"), "pages": ("NUMPAGES", "전체페이지"), "date": ("DATE", "날짜"), "time": ("TIME", "시간"),
    "title": ("TITLE", "제목"), "author": ("AUTHOR", "저자"), "file": ("FILENAME", "파일명"),
}


def _map(values: dict[str, str]) -> F.Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def media_type(ext) -> F.Column:
    return F.coalesce(F.element_at(_map(MEDIA_TYPES), F.lower(ext)), F.lit("application/octet-stream"))


def media_extension(media) -> F.Column:
    return F.coalesce(F.element_at(_map(EXTENSIONS), media), F.lit(".bin"))


def decode_characters(text) -> F.Column:
    """Named entities of the common kind; &amp; last."""
    out = text
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def decode_entities(text) -> F.Column:
    """decode_characters, and white-space runs as one space."""
    return F.regexp_replace(decode_characters(text), "[ \\t\\n\\r\\f\\x0B]+", " ")


def escape_markdown(text) -> F.Column:
    return F.regexp_replace(text, r"([\\`*_\[\]<>#~|^])", r"\\$1")


def escape_html(text) -> F.Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_attribute(text) -> F.Column:
    return F.replace(F.replace(escape_html(text), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#39;"))


def escape_cell(text) -> F.Column:
    return F.replace(F.replace(text, F.lit("\n"), F.lit("<br>")), F.lit("|"), F.lit("\\|"))


def escape_url(url) -> F.Column:
    return F.replace(F.replace(url, F.lit(" "), F.lit("%20")), F.lit(")"), F.lit("\\)"))


def emu_to_mm(x) -> F.Column:
    return x / 36000.0


def mm_to_emu(x) -> F.Column:
    return F.bround(x * 36000.0).cast("long")


def twips_to_mm(x) -> F.Column:
    return x / (1440.0 / 25.4)


def mm_to_twips(x) -> F.Column:
    return F.bround(x * (1440.0 / 25.4)).cast("long")


def hwpunit_to_mm(x) -> F.Column:
    return x / (7200.0 / 25.4)


def mm_to_hwpunit(x) -> F.Column:
    return F.bround(x * (7200.0 / 25.4)).cast("long")


def px_to_mm(x) -> F.Column:
    return x * 25.4 / 96.0


def pt_to_dip(x) -> F.Column:
    return x * 96.0 / 72.0


def dip_to_pt(x) -> F.Column:
    return x * 72.0 / 96.0


def rgba_to_hex(r, g, b, a) -> F.Column:
    """#RRGGBB, with the alpha only where it isn't 255."""
    return F.when(a == 255, F.format_string("#%02X%02X%02X", r, g, b)).otherwise(F.format_string("#%02X%02X%02X%02X", r, g, b, a))


def hex_to_rgba(code) -> F.Column:
    """struct r, g, b, a of #RRGGBB or #RRGGBBAA; null for any other length."""
    digits = F.regexp_replace(code, "^#", "")
    part = lambda k: F.conv(F.substring(digits, k, 2), 16, 10).cast("int")
    fine = F.length(digits).isin(6, 8) & digits.rlike("^[0-9A-Fa-f]*$")
    return F.when(fine, F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"), F.when(F.length(digits) == 8, part(7)).otherwise(255).alias("a")))


def roman(n) -> F.Column:
    """Roman numeral of a positive int below 4000."""
    digit = lambda d, one, five, ten: (
        F.when(d == 9, one + ten).when(d == 4, one + five).otherwise(F.concat(F.when(d >= 5, five).otherwise(""), F.repeat(F.lit(one), F.when(d >= 5, d - 5).otherwise(d).cast("int"))))
    )
    n = n.cast("int")
    th, hu, te, on = F.floor(n / 1000), F.floor(n / 100) % 10, F.floor(n / 10) % 10, n % 10
    return F.concat(F.repeat(F.lit("M"), th.cast("int")), digit(hu, "C", "D", "M"), digit(te, "X", "L", "C"), digit(on, "I", "V", "X"))


def number_text(n, style: str) -> F.Column:
    """An ordinal in a numbering style: decimal, alpha_lower, alpha_upper, roman_lower, roman_upper, hangul."""
    if style in ("alpha_lower", "alpha_upper"):
        out = F.char(F.lit(97 if style == "alpha_lower" else 65) + (n - 1) % 26)
        return out
    if style == "roman_upper":
        return roman(n)
    if style == "roman_lower":
        return F.lower(roman(n))
    if style == "hangul":
        at = F.lit(0xAC00) + ((n - 1) % 19) * 588
        return F.decode(F.unhex(F.lpad(F.hex(at.cast("long")), 4, "0")), "UTF-16BE")
    return n.cast("string")


def resolve_tokens(template, **values) -> F.Column:
    r"""A template with {PAGE} and the like filled in; names in any case and with spaces around, \{ and \} kept as braces.

    Values are put in as marks first and filled in last, so that a value is never read as a template.
    """
    out = F.replace(F.replace(F.coalesce(template, F.lit("")), F.lit("\\{"), F.lit("\u0001")), F.lit("\\}"), F.lit("\u0002"))
    names = list(TOKENS)
    for k, key in enumerate(names):
        out = F.regexp_replace(out, r"(?iu)\{\s*(?:" + "|".join(TOKENS[key]) + r")\s*\}", chr(0xE000 + k))
    for k, key in enumerate(names):
        out = F.replace(out, F.lit(chr(0xE000 + k)), F.coalesce(values.get(key, F.lit("")).cast("string"), F.lit("")))
    return F.replace(F.replace(out, F.lit("\u0001"), F.lit("{")), F.lit("\u0002"), F.lit("}"))


def is_external_ref(path) -> F.Column:
    """data: references and absolute URIs with a scheme of more than one letter."""
    return F.coalesce(path.rlike(r"(?i)^data:") | path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]+:"), F.lit(False))


def infer_heading(points) -> F.Column:
    """Heading level from a font size in points; 0 is body text."""
    out = F.lit(0)
    for level, least in ((6, 11.5), (5, 12.5), (4, 14), (3, 16), (2, 19), (1, 23)):
        out = F.when(points >= least, level).otherwise(out)
    return out.cast("int")


def field_text(field, at=None, page=None, pages=None, author=None, title=None) -> F.Column:
    """What a field placeholder of a run shows: date, time, page, pages, author or title; empty for what is not known."""
    none = F.lit(None).cast("string")
    text = lambda c: none if c is None else c.cast("string")
    shown = {"date": none if at is None else F.date_format(at, "yyyy-MM-dd"), "time": none if at is None else F.date_format(at, "HH:mm"), "page": text(page), "pages": text(pages), "author": text(author), "title": text(title)}
    out = F.lit(None).cast("string")
    for name, value in shown.items():
        out = F.when(F.lower(field) == name, value).otherwise(out)
    return F.coalesce(out, F.lit(""))
