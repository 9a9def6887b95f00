"""Texts of an archive: lines, fences, addresses, links, words, markup."""

from __future__ import annotations

import json
from html.entities import html5, name2codepoint

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions.contained import contained
from postmill.functions.names import WHITE, has, lower_ascii, upper_ascii

#: Fixed values.
STEPS = ("comments", "style", "script", "title", "downlevel_markers", "office_paragraph_tags")
LOSSES = ("tables_flattened", "rtf_not_converted", "undecodable_bytes_replaced", "invisible_padding_removed", "html_conversion_failed", "rtf_decompression_failed")
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(style|script|title)(?=[>/\s]).*?(?:</\1(?=[>/\s]|\z)[^>]*(?:>|\z)|\z)"
#: Elements whose tags separate words. Fixed values.
BLOCKS = (
    "address article aside blockquote body br caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
)
#: Entities beyond those of Latin-1 that are decoded. Fixed values.
NAMES = (
    "amp lt gt quot apos ensp emsp thinsp zwnj zwj lrm rlm ndash mdash lsquo rsquo sbquo ldquo rdquo bdquo dagger Dagger bull hellip permil lsaquo rsaquo "
    "euro trade larr uarr rarr darr minus ne le ge infin hearts OElig oelig Scaron scaron Yuml fnof circ tilde"
)
ENTITIES = {n: chr(c) for n, c in sorted(name2codepoint.items(), key=lambda x: x[1]) if 0xA0 <= c <= 0xFF} | {n: html5[f"{n};"] for n in NAMES.split()}
#: Characters that words are compared without. Fixed values.
MARKS = r"[*_~`\x{034F}\x{AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}]"


def newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def one_line(c: Column) -> Column:
    """Control characters gone, runs of white space one space, none at the ends. Most texts need nothing done, which one look tells."""
    changes = has(c, rf"[\x00-\x1F\x7F]|[{WHITE}][{WHITE}]|[{WHITE}&&[^ ]]|^ | \z")
    return F.when(changes, F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0E-\x1F\x7F]", ""), f"[{WHITE}]+", " "), "^ | $", "")).otherwise(c)


def title(c: Column) -> Column:
    t = one_line(F.coalesce(c, F.lit("")))
    return F.when(t == "", "(no subject)").otherwise(t)


def longest_backticks(c: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit("`+"), F.lit(0)), lambda m: F.char_length(m))), F.lit(0))


def fence(c: Column) -> Column:
    """Backticks, three at least and more than any run in the text."""
    return F.repeat(F.lit("`"), F.greatest(longest_backticks(c), F.lit(2)) + 1)


def code_span(c: Column) -> Column:
    ticks = F.repeat(F.lit("`"), longest_backticks(c) + 1)
    pad = F.when(F.startswith(c, F.lit("`")) | F.endswith(c, F.lit("`")), " ").otherwise("")
    return F.when(F.contains(c, F.lit("`")), F.concat(ticks, pad, c, pad, ticks)).otherwise(F.concat(F.lit("`"), c, F.lit("`")))


def address_text(display: Column, kind: Column, email: Column, smtp: Column) -> Column:
    """Name and address; an address of another kind than SMTP is shown only by its SMTP address."""
    return named_address(one_line(display), shown_address(kind, email, smtp))


def shown_address(kind: Column, email: Column, smtp: Column) -> Column:
    return F.coalesce(smtp, F.when(F.coalesce(upper_ascii(kind), F.lit("SMTP")) == "SMTP", email))


def named_address(name: Column, address: Column) -> Column:
    return F.when(name.isNotNull() & address.isNotNull() & (name != address), F.concat(name, F.lit(" <"), address, F.lit(">"))).otherwise(F.coalesce(address, name))


def is_blank(c: Column) -> Column:
    return c.isNull() | ~F.when((c >= "!") & (c < "\x7f"), True).otherwise(has(c, f"[^{WHITE}]"))  # most texts start with something visible, which needs no pattern


def link(name: Column) -> Column:
    """A file name as a relative link: only unreserved characters stay."""
    return F.replace(F.replace(F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def percent_decode(c: Column) -> Column:
    """Decoded where that gives UTF-8, else unchanged; malformed escapes stay."""
    parts = F.regexp_extract_all(c, F.lit(r"%[0-9A-Fa-f]{2}|[^%]+|%"), F.lit(0))
    data = F.transform(parts, lambda t: F.when(has(t, "^%.."), F.substring(t, 2, 2)).otherwise(F.hex(t)))
    return F.when(F.contains(c, F.lit("%")), F.coalesce(F.try_validate_utf8(F.unhex(F.array_join(data, "")).cast("string")), c)).otherwise(c)


def content_id_key(c: Column) -> Column:
    """Comparison key of a content id: trimmed, out of its angle brackets, decoded, lower case."""
    t = F.regexp_replace(c, f"^[{WHITE}]+|[{WHITE}]+$", "")
    return lower_ascii(percent_decode(F.regexp_replace(t, r"^<(.*)>$", "$1")))


def preprocessed(html: Column) -> Column:
    """HTML without comments, style, script and title elements, downlevel markers and office paragraph tags."""
    h = F.regexp_replace(html, HIDDEN, "")
    return F.regexp_replace(F.regexp_replace(h, r"(?s)<!\[.*?(?:\]>|\z)", ""), r"(?i)</?o:p(?:[/\s][^>]*)?>", "")


def applied(html: Column) -> Column:
    """Labels of the steps that change something, in order (what starts inside another hidden part counts as that part's)."""
    parts = F.regexp_extract_all(html, F.lit(HIDDEN), F.lit(0))
    bare = F.regexp_replace(html, HIDDEN, "")

    def some(start):
        return F.exists(parts, lambda p: F.startswith(F.lower(p), F.lit(start)))

    tests = [some(s) for s in ("<!--", "<style", "<script", "<title")]
    tests += [F.contains(bare, F.lit("<![")), has(bare, r"(?i)</?o:p[>/\s]")]
    return F.filter(F.array(*(F.when(t, label) for t, label in zip(tests, STEPS, strict=True))), lambda x: x.isNotNull())


def entity(m: Column) -> Column:
    """The character that an entity or a numeric reference stands for; null for one that is unknown. References into the C1 range mean
    what Windows-1252 has there; what is no character is U+FFFD."""
    body = F.substr(m, F.lit(2), F.char_length(m) - 2)
    digits, hexa = F.regexp_extract(body, r"^#0*([0-9]{1,10})$", 1), F.regexp_extract(body, r"^#[xX]0*([0-9A-Fa-f]{1,8})$", 1)
    value = F.when(digits != "", digits.cast("long")).when(hexa != "", F.conv(hexa, 16, 10).cast("long"))
    value = F.when(value < 1 << 32, value)
    c1 = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)]
    char = F.decode(F.unhex(F.lpad(F.hex(value), 8, "0")), "UTF-32")
    number = F.when((value == 0) | value.between(0xD800, 0xDFFF) | (value > 0x10FFFF), "\uFFFD").when(value.between(0x80, 0x9F), F.get(F.array(*map(F.lit, c1)), (value - 0x80).cast("int"))).when(value.isNotNull(), char)
    named = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))
    return F.coalesce(number, F.try_element_at(named, body))


def plain_words(c: Column) -> Column:
    """Words without marks of emphasis and invisible characters."""
    return F.filter(F.split(F.regexp_replace(c, MARKS, ""), f"[{WHITE}]+"), lambda w: w != "")


def alphanumeric_words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def table_rows(md: Column) -> Column:
    """Rows of Markdown tables, without the lines under their heads."""
    lines = F.split(md, "\n")
    return F.size(F.filter(lines, lambda x: has(x, r"^[ \t]*\|") & ~has(x, r"^[ \t]*\|[ \t:|-]*$")))


def compared(a: list[str], b: list[str], reach: int = 64) -> tuple[int, int, int, int]:
    """In-order comparison of word lists: (matched, missing from b, extra in b, steps without a resync). After a difference the
    word that the other side is at is looked for within reach and the shorter skip taken; if neither side has it, both go on by
    one word."""
    i = j = matched = missing = extra = unresynced = 0

    def skip(words, at, word):
        try:
            return words.index(word, at + 1, at + 1 + reach) - at
        except ValueError:
            return reach + 1

    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j, matched = i + 1, j + 1, matched + 1
            continue
        x, y = skip(a, i, b[j]), skip(b, j, a[i])
        if x <= y and x <= reach:
            i, missing = i + x, missing + x
        elif y <= reach:
            j, extra = j + y, extra + y
        else:
            i, j, missing, extra, unresynced = i + 1, j + 1, missing + 1, extra + 1, unresynced + 1
    return matched, missing + len(a) - i, extra + len(b) - j, unresynced


def align(a: list[str], b: list[str], reach: int = 64) -> tuple[int, int, int]:
    return compared(a, b, reach)[:3]


word_alignment = contained(lambda a, b: compared(list(a), list(b)), {n: T.IntegerType() for n in ("matched", "missing", "extra", "unresynced")})


UNSEEN = r"\x{034F}\x{AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}"
#: A whole run with eight invisible characters or more. It is looked for only where a run begins, so that long runs cost no more.
PADDING_RUN = rf"(?=[ \x{{A0}}{UNSEEN}])(?<![ \x{{A0}}{UNSEEN}])[ \x{{A0}}]*+(?:[{UNSEEN}][ \x{{A0}}]*+){{8,}}+"


def without_padding(md: Column) -> tuple[Column, Column]:
    """Text without invisible padding, and how many runs of it were taken out. A run with eight invisible characters or more becomes a
    space between texts, and nothing at the ends of a line. A line that held nothing else goes, and of the blank lines after it, up to
    the next text, those that would follow a blank line or stand first; every other line stays as it was."""
    beside = lambda c: has(c, f"[^{WHITE}{UNSEEN}]")
    # d: dropped, b: blank as it was, t: text
    kind = lambda was, now: F.when(~is_blank(now), "t").when(has(was, PADDING_RUN), "d").otherwise("b")

    def kept(after):
        kinds = F.array_join(F.zip_with(F.split(md, "\n", -1), after, kind), "")
        # D ends what stays of a gap: its first d, if a blank line is in front of it or no text, else the first blank line after it, which stays (B).
        ended = F.regexp_replace(F.regexp_replace(kinds, "(^b*+|tb++)d", "$1D"), "(td++)b", "$1BD")
        gone = F.regexp_replace(ended, r"(?:(D)|(?!^)\G)[bd]", "$1d")
        keeps = F.split(F.replace(F.regexp_replace(gone, "BD", "B"), F.lit("D"), F.lit("d")), "")
        return F.array_join(F.filter(F.zip_with(after, keeps, lambda line, keep: F.when(keep != "d", line)), lambda x: x.isNotNull()), "\n")

    def cleaned(pieces):
        """Of the pieces between the runs: the text is cut once, and what stands for a run follows from its neighbours."""
        space = lambda p, i: F.when((i > 0) & beside(F.left(p, F.lit(1))) & beside(F.right(F.get(pieces, i - 1), F.lit(1))), " ").otherwise("")
        inner = F.array_join(F.transform(pieces, lambda p, i: F.concat(space(p, i), p)), "")
        return F.when(F.size(pieces) > 1, F.get(F.transform(F.array(F.split(inner, "\n", -1)), kept), 0)).otherwise(F.get(pieces, 0))  # the lines are made once

    found = F.get(F.transform(F.array(F.split(md, PADDING_RUN, -1)), lambda pieces: F.struct(cleaned(pieces).alias("text"), F.when(F.size(pieces) > 1, F.size(pieces) - 1).otherwise(0).alias("runs"))), 0)
    return found["text"], found["runs"]


def is_syntax(word: Column) -> Column:
    """Words that Markdown's own marks make, not the text."""
    return has(word, r"^(?:[#>|:=+-]+|[0-9]{1,9}[.)])$")


def line_classes(md: Column) -> Column:
    """Numbers of headings, list items, quotes, table rows and rules among the lines."""
    lines = F.split(md, "\n")
    count = lambda p: F.size(F.filter(lines, lambda x: has(x, p)))
    return F.struct(count(r"^#{1,6} ").alias("headings"), count(r"^[ \t]*(?:[*+-]|[0-9]+[.)]) ").alias("items"), count(r"^>").alias("quotes"), count(r"^[ \t]*\|").alias("rows"), count(r"^(?:-{3,}|\*{3,})$").alias("rules"))


@F.pandas_udf(T.StringType())
def pretty(records: pd.Series) -> pd.Series:
    """JSON laid out by two spaces, fields in their order, a newline at the end."""
    return records.map(lambda r: json.dumps(json.loads(r), indent=2, ensure_ascii=False) + "\n", na_action="ignore")
