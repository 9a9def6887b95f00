"""HTML and Markdown as arrays of tokens: visible text, nesting, links with exact extents.

One alternation pattern cuts an HTML text into tokens that join to it: closed heads, declarations, tags, entities, runs of text. Its
repetitions are possessive, so a text of any length is cut in one pass without backtracking. What a token stands for is decided
token by token; nothing is searched in what an earlier step left.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions import texts
from postmill.functions.contained import contained
from postmill.functions.names import WHITE, has, lower_ascii

NAME_END = r"(?![A-Za-z0-9:_.\-])"
#: The rest of a tag up to its end: a quote opens a value only after "=", what is never closed goes on to the end of the text.
REST = rf"""(?:[^>=]++|=++[{WHITE}]*+(?:"[^"]*+"?+|'[^']*+'?+)?+)*+>?+"""
TAG_START = r"</?+[A-Za-z][A-Za-z0-9:_.\-]*+"
CLOSED_HEAD = rf"<(?i:head){NAME_END}{REST}(?s:.*?)</(?i:head)(?=[>/{WHITE}]|\z){REST}"
ENTITY = r"&(?:#[0-9A-Za-z]{0,31}|[0-9A-Za-z]{1,32});"
TOKEN = rf"{CLOSED_HEAD}|<[!?]{REST}|{TAG_START}{REST}|{ENTITY}|[^<&]++|[<&]"
BLOCK = rf"^</?(?i:{texts.BLOCKS.replace(' ', '|')}){NAME_END}"

#: Elements that hold nothing, and which open elements a start tag ends. Fixed values.
VOID = "area base br col embed hr img input link meta param source track wbr".split()
ENDS = {"p": ["p"], "li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "td": ["td", "th"], "th": ["td", "th"], "tr": ["tr", "td", "th"], "option": ["option"]}
#: Elements within elements beyond which a text isn't converted.
NESTING = 1000


def tokens(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def is_named_reference(token: Column) -> Column:
    return has(token, r"^&[0-9A-Za-z]{1,32};$")


def shown(token: Column) -> Column:
    """What a reader sees of a token: text, the character of an entity, a space for tags that start a block, for declarations and for
    closed heads. Names of entities that are unknown are dropped, malformed numbers are text."""
    first, second = F.substring(token, 1, 1), F.substring(token, 2, 1)
    long = F.char_length(token) > 1
    tag = F.when(second.isin("!", "?") | has(token, BLOCK) | (has(token, rf"^<(?i:head){NAME_END}") & has(token, rf"^{CLOSED_HEAD}\z")), " ").otherwise("")
    reference = F.coalesce(texts.entity(token), F.when(is_named_reference(token), "").otherwise(token))
    return F.when((first == "<") & long, tag).when((first == "&") & long, reference).otherwise(token)


def visible_text(html: Column) -> Column:
    """Text that a reader sees of HTML, its hidden parts taken out before."""
    return F.array_join(F.transform(tokens(texts.preprocessed(html)), shown), "")


def visible_words(html: Column) -> Column:
    return texts.plain_words(visible_text(html))


def unknown_entities(html: Column) -> Column:
    """How many references of a visible text have a name that stands for no character."""
    return F.size(F.filter(tokens(texts.preprocessed(html)), lambda t: is_named_reference(t) & texts.entity(t).isNull()))


def nesting(html: Column, limit: int = NESTING) -> Column:
    """How deep elements lie within elements, counted up to limit + 1. A start tag ends what it implies the end of, an end tag ends
    what is open within its element, one without an element does nothing; elements that hold nothing don't count."""
    tags = F.transform(F.regexp_extract_all(html, F.lit(r"</?+[A-Za-z][A-Za-z0-9:\-]*+[^>]*+>?+"), F.lit(0)), lambda t: lower_ascii(F.regexp_extract(t, r"^</?([A-Za-z][A-Za-z0-9:\-]*)", 1)))
    closing = F.transform(F.regexp_extract_all(html, F.lit(r"</?+[A-Za-z][A-Za-z0-9:\-]*+[^>]*+>?+"), F.lit(0)), lambda t: F.startswith(t, F.lit("</")))
    steps = F.filter(F.arrays_zip(tags.alias("name"), closing.alias("closing")), lambda s: s["closing"] | ~s["name"].isin(VOID))
    ended = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in ENDS.items() for x in pair))

    def kept(open_: Column, names: Column) -> Column:
        """open_ without the elements at its end that are among names."""
        return F.slice(open_, F.lit(1), F.coalesce(F.array_max(F.transform(open_, lambda x, i: F.when(~F.array_contains(names, x), i + 1).otherwise(0))), F.lit(0)))

    def step(state: Column, s: Column) -> Column:
        open_ = state["open"]
        at = F.array_position(F.reverse(open_), s["name"]).cast("int")
        closed = F.when(at > 0, F.slice(open_, F.lit(1), F.size(open_) - at)).otherwise(open_)
        implied = F.try_element_at(ended, s["name"])
        opened = F.concat(F.when(implied.isNotNull(), kept(open_, implied)).otherwise(open_), F.array(s["name"]))
        after = F.when(state["deepest"] > limit, open_).when(s["closing"], closed).otherwise(opened)
        return F.struct(after.alias("open"), F.greatest(state["deepest"], F.size(after)).alias("deepest"))

    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit(0).alias("deepest"))
    return F.when(html.isNotNull(), F.aggregate(steps, start, step, lambda s: s["deepest"]))


#: A destination of Markdown with its "](" and what the destination is. A content id ends at ")", ">" or white space.
LINK_START, CONTENT_ID = r"\]\(", rf"(?i:cid:)([^)>{WHITE}]*+)"
CID_LINK = rf"(\]\()(?:<{CONTENT_ID}>?+|{CONTENT_ID})"


def content_links(md: Column) -> Column:
    """Array of (pos, before, written, cid) of the cid: destinations in order: the text between the destination before and this one,
    the destination as written, its content id. What follows the last one is content_rest. Texts and destinations join to the whole."""
    found = F.regexp_extract_all(md, F.lit(CID_LINK), F.lit(0)).alias("found")
    pairs = F.arrays_zip(F.split(md, CID_LINK, -1).alias("between"), found)  # the text is cut once, not once a link; the last piece has no link
    one = lambda p, i: F.struct(i.alias("pos"), F.concat(p["between"], F.lit("](")).alias("before"), F.substr(p["found"], F.lit(3)).alias("written"), F.regexp_extract(p["found"], r"^\]\(<?.{4}([^>]*)>?$", 1).alias("cid"))
    return F.transform(F.filter(pairs, lambda p: p["found"].isNotNull()), one)


def has_content_link(md: Column) -> Column:
    return has(md, CID_LINK)


def content_rest(md: Column) -> Column:
    return F.element_at(F.split(md, CID_LINK, -1), -1)


def link_spans(text: str, most: int = 16) -> list[tuple[int, int]]:
    """Stretches of Markdown that are no text, in order: images whole, of links the bracket before their text and what follows it.
    Brackets and parentheses of a link balance, an escaped character counts for nothing; links within links' texts to a depth."""
    stacks, pairs, escaped, i = {"]": [], ")": []}, {}, set(), 0
    while i < len(text):  # which bracket closes which
        c = text[i]
        if c == "\\":
            escaped.add(i + 1)
            i += 1
        elif c in "[(":
            stacks["]" if c == "[" else ")"].append(i)
        elif c in stacks and stacks[c]:
            pairs[stacks[c].pop()] = i
        i += 1

    def end_of(start: int) -> int | None:
        """Where the destination ends whose parenthesis is at start; one in angle brackets may hold any."""
        if text[start + 1 : start + 2] != "<":
            return pairs[start] + 1 if start in pairs else None
        j, depth = text.find(">", start) + 1 or len(text), 1
        while j < len(text) and depth:
            if text[j] == "\\":
                j += 1
            else:
                depth += (text[j] == "(") - (text[j] == ")")
            j += 1
        return None if depth else j

    out, inside, i = [], [], 0
    for at in sorted(k for k in pairs if text[k] == "["):
        close = pairs[at]
        while inside and inside[-1][0] <= at:
            i = max(i, inside.pop()[1])
        if at < i or text[close + 1 : close + 2] != "(":
            continue
        end = end_of(close + 1)
        if end is None or inside and end > inside[-1][0]:
            continue
        if at > i and text[at - 1] == "!" and at - 1 not in escaped:
            out.append((at - 1, end))
            i = end
        elif len(inside) < most:
            out += [(at, at + 1), (close, end)]
            inside.append((close, end))
    return sorted(out)


def unwrapped(text: str) -> str:
    """Markdown without images, links as their text, escapes undone; a line break written as an escape is a space."""
    out, at = [], 0
    for start, end in [*link_spans(text), (len(text), len(text))]:
        out.append(text[at:start])
        at = max(at, end)
    return re.sub(r"\\([!-/:-@\[-`{-~])|\\\n", lambda m: m[1] or " ", "".join(out))


without_links = contained(lambda text: (unwrapped(text),), {"text": T.StringType()})


def markdown_text(md: Column) -> Column:
    """Markdown as its text."""
    return F.when(has(md, r"\]\(|\\"), without_links(md)["text"]).otherwise(md)


def markdown_words(md: Column) -> Column:
    """Words of Markdown, automatic links out of their brackets."""
    auto = r"^<(?:.*://.*|mailto:.*)>$"
    return F.transform(texts.plain_words(markdown_text(md)), lambda w: F.when(has(w, auto), F.substr(w, F.lit(2), F.char_length(w) - 2)).otherwise(w))
