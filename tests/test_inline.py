"""Runs of Markdown against a plain stack machine written for the test."""

import random
import re
import unicodedata

import pytest
from leafmill.operators import inline as I


def plain_runs(text):
    """The same rules as loops over lists."""
    raw = [m.group(0) for m in re.finditer(I.PIECES, text)]
    links, stack = [], []
    for i, x in enumerate(raw):
        if x in ("[", "!["):
            stack.append([i, x == "![", True])
        elif x.startswith("]") and stack:
            o, image, live = stack.pop()
            if x.startswith("](") and live:
                url = re.match(r"(?s)\]\(\s*(<[^<>\n]*>|(?:[^\s()<]|\([^\s()]*\))*)", x).group(1)
                links.append((o, i, image, re.sub(r"^<|>$", "", url)))
                if not image:
                    for s in stack:
                        s[2] = s[2] and s[1]
    opens, ends = {o: (o, c, im, u) for o, c, im, u in links}, {c: (o, c, im, u) for o, c, im, u in links}
    blank = lambda c: c.isspace()
    punct = lambda c: unicodedata.category(c)[0] in "PS"
    pairs, stack, inside, images = [], [], [], 0
    for i, x in enumerate(raw):
        if i in opens:
            inside.append(i)
            images += opens[i][2]
        elif i in ends:
            stack = [s for s in stack if s["ctx"] != inside[-1]]
            inside.pop()
            images -= ends[i][2]
        elif re.fullmatch(r"\*+|_+|~+|\^+", x):
            a, b = raw[i - 1][-1] if i else " ", raw[i + 1][0] if i + 1 < len(raw) else " "
            left = not blank(b) and (not punct(b) or blank(a) or punct(a))
            right = not blank(a) and (not punct(a) or blank(b) or punct(b))
            o = left and (x[0] != "_" or not right or punct(a))
            c = right and (x[0] != "_" or not left or punct(b))
            here, rem = inside[-1] if inside else -1, len(x)
            while c and rem:
                at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k]["ch"] == x[0] and stack[k]["ctx"] == here and not ((stack[k]["both"] or (o and c)) and (stack[k]["len"] + len(x)) % 3 == 0 and not (stack[k]["len"] % 3 == 0 and len(x) % 3 == 0))), None)
                if at is None:
                    break
                n = 2 if x[0] != "^" and stack[at]["rem"] >= 2 and rem >= 2 else 1
                pairs.append((stack[at]["i"], i, "" if images else x[0], n))
                stack[at]["rem"] -= n
                rem -= n
                stack = stack[: at + (stack[at]["rem"] > 0)]
            if o and rem:
                stack.append({"i": i, "ch": x[0], "len": len(x), "rem": rem, "both": o and c, "ctx": here})
    out = []
    for i, x in enumerate(raw):
        styles = {I.PAIRED[ch, n] for o, c, ch, n in pairs if ch and o < i < c}
        link = next((u for o, c, im, u in links if not im and o < i < c), None)
        kind, text = "text", x
        if i in opens:
            text = "[" if opens[i][2] else ""
        elif i in ends:
            text = f"]({ends[i][3]})" if ends[i][2] else ""
        elif re.fullmatch(r"\*+|_+|~+|\^+", x):
            text = x[: len(x) - sum(n for o, c, _, n in pairs if i in (o, c))]
        elif re.fullmatch(r"(?: {2,}|\\)\n *", x):
            kind, text = "break", "\n"
        elif re.fullmatch(r"(?s)(`+).+\1", x):
            kind, text = "code", x.strip("`").replace("\n", " ")
            if text[:1] == " " == text[-1:] and text.strip(" "):
                text = text[1:-1]
        elif re.fullmatch(r" ?\n *", x):
            text = " "
        elif re.fullmatch(r"\\[!-/:-@\[-`{-~]", x):
            text = x[1]
        if not text:
            continue
        key = (kind, *(s in styles for s in I.TEXT_STYLES), link is not None, link)
        if kind == "text" and out and out[-1][0] == key:
            out[-1] = (key, out[-1][1] + text)
        else:
            out.append((key, text))
    return out


def runs(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "0 AS block_no", "text")
    out = {k: [] for k in range(len(texts))}
    for r in I.md_inline(df).orderBy("doc_id", "run_no").collect():
        out[r.doc_id].append(((r.kind, *(r[s] for s in I.TEXT_STYLES), r.underline, r.url), r.text))
    return out


def test_nested_marks(spark):
    text = "[a **b *c* d**](u) ***x** y* ![*alt*](p) `**` \\*z\\* foo__bar__ *(e)*f"
    got = [(t, "".join(n for n, on in zip("bislp", k[1:6], strict=True) if on), k[0], k[7]) for k, t in runs(spark, [text])[0]]
    assert got == [("a ", "", "text", "u"), ("b ", "b", "text", "u"), ("c", "bi", "text", "u"), (" d", "b", "text", "u"), (" ", "", "text", None), ("x", "bi", "text", None), (" y", "i", "text", None), (" [alt](p) ", "", "text", None), ("**", "", "code", None), (" *z* foo__bar__ *(e)*f", "", "text", None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_loops(spark, seed):
    rng = random.Random(seed)
    bits = ["*", "**", "***", "_", "__", "~", "~~", "^", "a", "b", " ", " ", "x.", "(", ")", "[", "![", "](u)", "](<v w> 't')", "]", "`", "``", "\\*", "\n", "  \n", "é", "!", "****"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 24))) for _ in range(1500)] + ["", "*" * 40 + "a" + "*" * 40, "*a _b " * 300 + "c_ d*" * 300]
    got = runs(spark, texts)
    for k, t in enumerate(texts):
        assert got[k] == plain_runs(t), t
    assert runs(spark, [None]) == {0: []}
