"""The token arrays against readers of my own that go through a text character by character."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postmill.functions import markup, texts
from postmill.operators import links

BLOCK = set(texts.BLOCKS.split())
INVISIBLE = "*_~`͏­​‌‍⁠﻿"


def tag_end(t, i):
    quote, prev = None, "<"
    i += 1
    while i < len(t):
        c = t[i]
        if quote:
            if c == quote:
                quote, prev = None, c
        else:
            if c in "\"'" and prev == "=":
                quote = c
            elif c == ">":
                return i + 1
            if not c.isspace():
                prev = c
        i += 1
    return len(t)


def name_at(t, i):
    j = i
    while j < len(t) and (t[j].isascii() and t[j].isalnum() or t[j] in ":-_."):
        j += 1
    return t[i:j].lower() if t[i : i + 1].isascii() and t[i : i + 1].isalpha() else ""


def reference(t, i):
    """(character or None, end) of an entity at i, or None where it is text."""
    j = t.find(";", i)
    body = t[i + 1 : j] if j > 0 else ""
    if not 1 <= len(body) <= 32 or not all(c.isascii() and c.isalnum() for c in body.removeprefix("#")):
        return None
    if body[0] == "#":
        hexa = body[1:2] in ("x", "X")
        try:
            n = int(body[2:], 16) if hexa else int(body[1:])
        except ValueError:
            return None
        if n >= 2**32:
            return None
        if 0x80 <= n <= 0x9F:
            return bytes([n]).decode("cp1252", "ignore") or chr(n), j + 1
        return "�" if n == 0 or n > 0x10FFFF or 0xD800 <= n <= 0xDFFF else chr(n), j + 1
    return texts.ENTITIES.get(body), j + 1


def read(t):
    out, unknown, i = [], 0, 0
    while i < len(t):
        c = t[i]
        if c == "<" and t[i + 1 : i + 2] in ("!", "?"):
            out.append(" ")
            i = tag_end(t, i)
        elif c == "<" and (name := name_at(t, i + 1 + (t[i + 1 : i + 2] == "/"))):
            end = tag_end(t, i)
            if name in BLOCK:
                out.append(" ")
            if name == "head" and t[i + 1] != "/":
                k = end
                while (k := t.lower().find("</head", k)) >= 0 and not (k + 6 == len(t) or t[k + 6] in ">/" or t[k + 6].isspace()):
                    k += 1
                if k >= 0:
                    out.append(" ")
                    end = tag_end(t, k)
            i = end
        elif c == "&" and (found := reference(t, i)):
            out.append(found[0] or "")
            unknown += found[0] is None
            i = found[1]
        else:
            out.append(c)
            i += 1
    return "".join(out), unknown


PARTS = ["<p>", "</p>", "<", ">", " < ", "<a title=\"x > y\">", "<a t='>' b = \"", "\"", "'", "=", "<head>", "</head>", "</HEAD >", "<head\t>", "</header>", "<header>", "&amp;", "&unknown;", "&#65;", "&#x1F600;", "&#xZ;", "&", ";", "&#0;", "&#150;", "&#4294967296;",
         "<br/>", "<!DOCTYPE x>", "<?x \">\" ?>", "<h1y>", "<H1>", "text ", "é", " ", "­", "*b*", "\n", "</", "<1>", "<td", "<td>", "<x-y:z.w_v q>"]
CASES = [
    "<p>5 < 6 and 7 > 2 end</p>", '<a title="x > y">link</a>', "<head><meta>gone</head>body", "<head>kept", "<head a='</head>'>b</head >c", "a<b", "<", "", "<a title=it's>it's</a>", "x<!-->y", "<head></head", "</head>x", "<head x></headx>y</head/>z",
    "&copy&copy;", "&" + "a" * 33 + ";", "&" + "a" * 32 + ";", "&#" + "0" * 29 + "65;", "<a = = \"x>\">t", "<" + "a" * 5000 + ">t", "<a " + "= " * 20000, "<a " + "='x' " * 20000 + ">end", "&" * 3000, "<head>" * 300, "<p " + "b='" * 3000,
]


def fuzz(parts, n, seed=4):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(n)]


def test_visible_text_is_what_the_rule_reads(spark):
    cases = CASES + fuzz(PARTS, 1500)
    df = spark.createDataFrame(list(enumerate(cases)), "i int, h string")
    kinds = F.filter(markup.tokens(F.col("h")), lambda t: markup.is_named_reference(t) & texts.entity(t).isNull())
    got = df.select("i", F.array_join(F.transform(markup.tokens(F.col("h")), markup.shown), "").alias("t"), F.size(kinds).alias("u"), F.array_join(markup.tokens(F.col("h")), "").alias("whole")).collect()
    for r in got:
        assert r.whole == cases[r.i] and (r.t, r.u) == read(cases[r.i]), cases[r.i][:200]


def test_hidden_parts_go_first_and_null_stays(spark):
    df = spark.createDataFrame([(0, "a<!-- <p>x</p> -->b<style>p>q{}</style>c<script>if (a<b) '</p>'</script>d&nbsp;<b>e</b>&nosuch;f&amp;lt;"), (1, None)], "i int, h string")
    got = df.orderBy("i").select(markup.visible_text(F.col("h")).alias("t"), markup.visible_words(F.col("h")).alias("w"), markup.unknown_entities(F.col("h")).alias("u")).collect()
    assert got[0].t == "abcd ef&lt;" and got[0].w == ["abcd", "ef&lt;"] and got[0].u == 1
    assert got[1].t is None


def test_words_lose_marks_and_invisible_characters(spark):
    df = spark.createDataFrame([(f"so{c}ft {c} x" if c else "",) for c in INVISIBLE], "t string")
    assert {tuple(r.w) for r in df.select(texts.plain_words(F.col("t")).alias("w")).collect()} == {("soft", "x")}
    words = ["123456789.", "1234567890.", "1)", ".", "##", "#a", ">|:=+-", "", "*", "١."]
    got = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").select(texts.is_syntax(F.col("w")).alias("s")).collect()
    assert [r.s for r in got] == [True, False, True, False, True, False, True, False, False, False]


def deepest(html, limit):
    import re

    opened, most = [], 0
    for m in re.finditer(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)[^>]*>?", html):
        name = m[2].lower()
        if m[1]:
            if name in opened:
                del opened[len(opened) - 1 - opened[::-1].index(name) :]
        elif name not in markup.VOID:
            while opened and opened[-1] in markup.ENDS.get(name, []):
                opened.pop()
            opened.append(name)
            most = max(most, len(opened))
            if most > limit:
                return limit + 1
    return most


def test_nesting(spark):
    parts = ["<p>", "<div>", "</div>", "<li>", "<ul>", "</ul>", "<td>", "<tr>", "<table>", "</table>", "<br>", "<img/>", "</p>", "text", "<DT>", "<dd>", "<option>", "<div/>", "<", "<!-- <b>", "<a x", "</tr>", "<th>"]
    cases = fuzz(parts, 400) + ["", "<p>" * 3000, "<div>" * 60, "<table><tr><td>a<td>b<tr><td>c"]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, h string")
    for limit in (4, 50):
        got = {r.i: r.d for r in df.select("i", markup.nesting(F.col("h"), limit).alias("d")).collect()}
        assert got == {i: deepest(c, limit) for i, c in enumerate(cases)}


def extent(t, start):
    """(end of text, end) of a link whose bracket is at start."""
    depth, i = 0, start
    while True:
        if i >= len(t):
            return None
        if t[i] == "\\":
            i += 2
            continue
        if t[i] == "[":
            depth += 1
        elif t[i] == "]":
            depth -= 1
            if not depth:
                break
        i += 1
    if t[i + 1 : i + 2] != "(":
        return None
    j, depth = i + 2, 1
    if t[j : j + 1] == "<":
        while j < len(t):
            j += 1
            if t[j - 1] == ">":
                break
    while j < len(t):
        if t[j] == "\\":
            j += 2
            continue
        depth += (t[j] == "(") - (t[j] == ")")
        if not depth:
            return i, j + 1
        j += 1
    return None


def text_of(t, depth=0):
    out, i = [], 0
    while i < len(t):
        c = t[i]
        if c == "\\" and i + 1 < len(t) and t[i + 1] in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
            out.append(t[i + 1])
            i += 2
        elif t[i : i + 2] == "\\\n":
            out.append(" ")
            i += 2
        elif t[i : i + 2] == "![" and (x := extent(t, i + 1)):
            i = x[1]
        elif c == "[" and (x := extent(t, i)) and depth < 16:
            out.append(text_of(t[i + 1 : x[0]], depth + 1))
            i = x[1]
        else:
            out.append(c)
            i += 1
    return "".join(out)


def test_markdown_text_balances_brackets(spark):
    parts = ["[", "]", "](", "(", ")", "![", "\\", "\\[", "a", " b ", "<", ">", "](<x)>", "[l](u)", "![i](v(w))", "\\\n", "\n", "é", "!", "](a)"]
    cases = fuzz(parts, 3000) + ["[" * 20 + "x" + "](y)" * 20, "[a](" * 400, "[![i](x)](y) z", "[a [b](c) d](e)", "[a](b (c) d) e", "[a](<b)> c) d", r"\[a](b) \![c](d)", "[" * 3000, ""]
    got = {r.i: r.t for r in spark.createDataFrame(list(enumerate(cases)), "i int, m string").select("i", markup.markdown_text(F.col("m")).alias("t")).collect()}
    for i, c in enumerate(cases):
        assert got[i] == text_of(c), c
    words = spark.createDataFrame([("<http://x.y> <mailto:a@b> <c> [k](<l m>) *n*",)], "m string").select(markup.markdown_words(F.col("m")).alias("w")).first().w
    assert words == ["http://x.y", "mailto:a@b", "<c>", "k", "n"]


def test_content_links_have_exact_extents(spark):
    md = "a [x](cid:A@b) ![y](<CID:c%40d> \"t\") [z](http://q) ![](cid:) [w](<cid:e f)> é](Cid:g"
    r = spark.createDataFrame([(md,)], "m string").select(markup.content_links(F.col("m")).alias("l"), markup.content_rest(F.col("m")).alias("rest")).first()
    assert [(x.pos, x.written, x.cid) for x in r.l] == [(0, "cid:A@b", "A@b"), (1, "<CID:c%40d>", "c%40d"), (2, "cid:", ""), (3, "<cid:e", "e"), (4, "Cid:g", "g")]
    assert "".join(x.before + x.written for x in r.l) + r.rest == md


@pytest.fixture(scope="module")
def linked(spark):
    docs = [(1, "[a](cid:one@x) [b](cid:ONE@X) ![c](<cid:two%40x>) [d](cid:dup) [e](cid:none) [f](cid:bad) [g](cid:) end"), (2, "no links"), (3, None), (4, "[a](cid:one@x)"), (5, "![p](cid:%3Cthree%3E)")]
    files = [(1, "<One@x>", "extracted", "a b(1).png"), (1, "two@x", "extracted", "é.gif"), (1, "dup", "extracted", "d1"), (1, "DUP", "extracted", "d2"), (1, "bad", "failed", "f"), (1, "", "extracted", "empty"), (1, None, "extracted", "none"), (5, " <three> ", "extracted", "t~.x"), (5, "three", "failed", "u")]
    return {r.message_id: r for r in links.rewritten(spark.createDataFrame(docs, "message_id long, markdown string"), spark.createDataFrame(files, "message_id long, content_id string, status string, file string")).collect()}


def test_links_point_to_files(linked):
    assert linked[1].markdown == "[a](attachments/a%20b%281%29.png) [b](attachments/a%20b%281%29.png) ![c](attachments/%C3%A9.gif) [d](cid:dup) [e](cid:none) [f](cid:bad) [g](cid:) end"
    r = linked[1]
    assert (r.links, r.distinct_ids, r.rewritten, r.no_attachment, r.not_extracted, r.ambiguous) == (7, 6, 3, 2, 1, 1)
    assert linked[5].markdown == "![p](cid:%3Cthree%3E)" and linked[5].no_attachment == 1
    assert linked[2].markdown == "no links" and linked[2].links == 0 and linked[3].markdown is None
    assert linked[4].no_attachment == 1 and linked[4].markdown == "[a](cid:one@x)"


def test_percent_decoding(spark):
    cases = {"a%40b": "a@b", "%C3%A9": "é", "%ff": "%ff", "%4": "%4", "100%": "100%", "%zz%41": "%zzA", "plain": "plain", "": "", "é%20": "é ", "+": "+"}
    got = {r.v: r.d for r in spark.createDataFrame([(k,) for k in cases], "v string").select("v", texts.percent_decode(F.col("v")).alias("d")).collect()}
    assert got == cases
    assert Counter(texts.MARKS) and spark.createDataFrame([(None,)], "v string").select(texts.content_id_key(F.col("v")).alias("d")).first().d is None


def test_a_text_of_many_links_is_cut_once(spark):
    n = 20_000
    text = "".join(f"see [a](cid:x{i}) and " for i in range(n)) + "end"
    documents = spark.createDataFrame([(1, text)], "message_id long, markdown string")
    attachments = spark.createDataFrame([(1, f"x{i}", "extracted", f"f{i}") for i in range(0, n, 2)], "message_id long, content_id string, status string, file string")
    began = time.monotonic()
    got = links.rewritten(documents, attachments).first()
    assert time.monotonic() - began < 60  # one cut of the text for each link takes minutes
    assert got.markdown == "".join(f"see [a]({f'cid:x{i}' if i % 2 else f'attachments/f{i}'}) and " for i in range(n)) + "end" and (got.links, got.rewritten, got.no_attachment) == (n, n // 2, n // 2)
