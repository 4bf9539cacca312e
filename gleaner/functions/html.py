"""HTML to text with regular expressions only.

Every pattern is free of look-around and back-references. An element that is left
open loses its tag and nothing else, and costs one pass: containers are cut off
by splitting at their start tags, not by searching for an end from each.
"""

from __future__ import annotations

import html.entities
import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Elements without text for the reader; in HTML the first two take all that
# follows if they are left open, and a title holds no tags.
SILENT_PATTERN = (
    r"(?is)<(?:script(?:\s[^>]*)?(?:>|\z).*?(?:</script\s*>|\z)|style(?:\s[^>]*)?(?:>|\z).*?(?:</style\s*>|\z)"
    r"|!--.*?(?:-->|\z)|title(?:\s[^>]*)?>[^<]*(?:</title\s*>)?)"
)
# Containers that are dropped with their content if they are closed.
CONTAINERS = ["noscript", "template", "nav", "footer", "aside", "select", "button"]
# A division of the class "ad", whatever the quotes and other classes.
AD_PATTERN = (
    r"""(?i)<div\s(?:[^>]*\s)?class\s*=\s*(?:"(?:[^">]*\s)?ad(?:\s[^">]*)?"|'(?:[^'>]*\s)?ad(?:\s[^'>]*)?'|ad[\s>])(?:[^>]*>)?"""
)
# Elements that end a line of text.
BREAKING = [
    "p", "br", "h[1-6]", "div", "section", "article", "main", "ul", "ol", "li", "dl", "dt", "dd",
    "table", "tr", "td", "th", "blockquote", "pre", "hr", "title",
]
# Names of characters by the HTML standard, without the ampersand's own, which
# are decoded last; a no-break space reads as a space.
NAMED = {
    n[:-1]: v.replace("\xa0", " ") for n, v in html.entities.html5.items() if n.endswith(";") and n not in ("amp;", "AMP;")
}


BREAK_PATTERN = r"(?i)</?(?:" + "|".join(BREAKING) + r")(?:\s[^>]*)?/?>"
TAG_PATTERN = r"<[A-Za-z/!?][^>]*(?:>|\z)"
ARTICLE_PATTERN = r"(?is)<article(?:\s[^>]*)?>(.*?)(?:</article\s*>|\z)"
ANCHOR_START = r"(?i)<a\s"
# What follows the start of an anchor: its link target and its content.
HREF_PATTERN = r"""(?is)^(?:[^>]*\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
ANCHOR_CONTENT = r"(?is)^[^>]*>(.*?)(?:</a\s*>|\z)"


def _code_point(code: Column) -> Column:
    number = F.when(
        F.lower(F.left(code, F.lit(1))) == "x", F.conv(F.substring(code, 2, 8), 16, 10)
    ).otherwise(code).cast("long")
    usable = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.when(usable, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("")


def _decode_named(text: Column) -> Column:
    """Only names that occur are looked up, each once."""
    table = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")
    found = F.array_distinct(F.regexp_extract_all(text, F.lit("&([A-Za-z][A-Za-z0-9]*);"), F.lit(1)))
    known = F.filter(found, lambda n: F.try_element_at(table, n).isNotNull())
    decoded = F.aggregate(
        known, text, lambda acc, n: F.replace(acc, F.concat(F.lit("&"), n, F.lit(";")), F.try_element_at(table, n))
    )
    return F.when(text.rlike("&[A-Za-z][A-Za-z0-9]*;"), decoded).otherwise(text)


def _decode_numeric(text: Column) -> Column:
    codes = F.array_distinct(
        F.regexp_extract_all(text, F.lit("&#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"), F.lit(1))
    )
    decoded = F.aggregate(
        codes, text, lambda acc, c: F.replace(acc, F.concat(F.lit("&#"), c, F.lit(";")), _code_point(c))
    )
    return F.when(F.contains(text, F.lit("&#")), decoded).otherwise(text)


def _guard_ampersand(text: Column) -> Column:
    """Spell numeric ampersands by name, so that they are decoded last."""
    spelled = F.regexp_replace(text, "&#(?:0*38|[xX]0*26);", "&amp;")
    return F.when(F.contains(text, F.lit("&#")), spelled).otherwise(text)


def decode_entities(text: Column) -> Column:
    """Named and numeric character references, each decoded exactly once.

    Every step first looks whether it has anything to do.
    """
    text = let(let(let(text, _guard_ampersand), _decode_named), _decode_numeric)
    return F.replace(F.replace(text, F.lit("&AMP;"), F.lit("&")), F.lit("&amp;"), F.lit("&"))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, TAG_PATTERN, "")


def _drop_closed(page: Column, name: str) -> Column:
    """``page`` without the elements ``name`` up to their first end tag; one that
    is not closed loses its tag."""
    pieces = F.split(page, rf"(?i)<{name}(?:\s[^>]*)?>")
    ended = F.transform(
        pieces, lambda p, i: F.when(i > 0, F.regexp_replace(p, rf"(?is)^.*?</{name}\s*>", " ")).otherwise(p)
    )
    return F.when(page.rlike(f"(?i)<{name}"), F.array_join(ended, " ")).otherwise(page)


def _closed_dropper(name: str):
    return lambda page: _drop_closed(page, name)


def _drop_outer_headers(page: Column) -> Column:
    """Headers go, but those of articles, which hold headlines, stay."""
    pieces = F.split(page, r"(?i)<article(?:\s[^>]*)?>")

    def cut(piece: Column, i: Column) -> Column:
        ends = F.split(piece, r"(?i)</article\s*>", 2)
        after = F.when(F.size(ends) > 1, F.concat(F.lit("</article>"), _drop_closed(F.get(ends, F.lit(1)), "header")))
        inside = F.concat(F.lit("<article>"), F.get(ends, F.lit(0)), F.coalesce(after, F.lit("")))
        return F.when(i > 0, inside).otherwise(_drop_closed(piece, "header"))

    return F.when(page.rlike("(?i)<header"), F.array_join(F.transform(pieces, cut), "")).otherwise(page)


def _drop_ads(page: Column) -> Column:
    """Advertising divisions go with all that is nested in them; one whose end is
    missing loses its tag."""
    pieces = F.split(page, AD_PATTERN)

    def cut(piece: Column, i: Column) -> Column:
        parts = F.split(piece, r"(?i)</div\s*>")
        # the end is the first at which as many divisions were closed as opened, and one more
        state = F.aggregate(
            F.transform(parts, lambda p: F.regexp_count(p, F.lit(r"(?i)<div[\s>]"))),
            F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end")),
            lambda acc, opened: F.struct(
                (acc["depth"] + opened - 1).alias("depth"),
                (acc["at"] + 1).alias("at"),
                F.when((acc["end"] == 0) & (acc["depth"] + opened - 1 <= 0), acc["at"] + 1).otherwise(acc["end"]).alias("end"),
            ),
        )
        rest = let(
            F.when(state["end"] < F.size(parts), state["end"]).otherwise(0),
            lambda end: F.when(end > 0, F.concat(F.lit(" "), F.array_join(F.slice(parts, end + 1, F.size(parts)), "</div>"))).otherwise(piece),
        )
        return F.when(i > 0, rest).otherwise(piece)

    return F.when(page.rlike(AD_PATTERN), F.array_join(F.transform(pieces, cut), " ")).otherwise(page)


def html_to_text(html: Column) -> Column:
    """Readable text, one block per line, without navigation, scripts and ads."""
    page = F.regexp_replace(html, SILENT_PATTERN, " ")
    page = let(let(page, lambda p: _drop_ads(p)), lambda p: _drop_outer_headers(p))
    for name in CONTAINERS:
        page = let(page, _closed_dropper(name))
    text = strip_tags(F.regexp_replace(page, BREAK_PATTERN, "\n"))
    text = F.regexp_replace(decode_entities(text), r"[ \t\r\f]+", " ")
    text = F.regexp_replace(text, r" ?\n[ \n]*", "\n")
    return F.btrim(text, F.lit(" \n"))


def article_text(html: Column) -> Column:
    """Text of the ``article`` elements; of the whole page where it has none."""
    bodies = F.regexp_extract_all(html, F.lit(ARTICLE_PATTERN), F.lit(1))
    return html_to_text(F.when(F.size(bodies) > 0, F.array_join(bodies, "\n")).otherwise(html))


# Main block: what a block is worth, in characters.
BLOCK_COST = 20  # of a block with text, which must hold more than this to count for a run
LINK_COST = 3  # of each character inside a link
GOOD_HINT, BAD_HINT = 25, -75  # of a class, an id or an element that tells
GOOD_WORDS = "article|content|entry|main|post|story|text"
BAD_WORDS = "nav|menu|footer|sidebar|comment|promo|share|related|sponsor"
SECTIONS = ["nav", "footer", "aside", "header", "form", "button", "select"]
BLOCK_TAG = r"(?i)(</?(?:" + "|".join([*BREAKING, *SECTIONS]) + r")(?:\s[^>]*)?/?>)"
BLOCK_MARK = "\u0001"
_SPACES = r"[ \t\r\f\n]+"


def _scored_block(piece: Column) -> Column:
    """Text (entities as they are) and score of a block with its opening tag."""
    tag = F.regexp_extract(piece, r"^<[^>]*>", 0)
    body = F.substring(piece, F.char_length(tag) + 1, F.char_length(piece))
    unlinked = F.regexp_replace(body, r"(?is)<a(?:\s[^>]*)?>.*?(?:</a\s*>|\z)", " ")
    text, plain = (F.btrim(F.regexp_replace(strip_tags(x), _SPACES, " ")) for x in (body, unlinked))
    named = r"(?i)\s(?:class|id)\s*=[^>]*(?:{})"
    hint = (
        F.when(tag.rlike(named.format(BAD_WORDS)) | tag.rlike(rf"(?i)^<(?:{'|'.join(SECTIONS)})[\s>]"), BAD_HINT)
        .when(tag.rlike(named.format(GOOD_WORDS)), GOOD_HINT)
        .otherwise(0)
    )
    free = F.char_length(plain)
    score = free - LINK_COST * F.greatest(F.char_length(text) - free, F.lit(0)) - F.when(text != "", BLOCK_COST).otherwise(0) + hint
    return F.struct(text.alias("text"), score.alias("score"))


def _best_run(blocks: Column) -> Column:
    """``begin`` and ``end`` of the consecutive blocks with the largest sum of
    scores; the first that ends, then the longest. Without a positive sum it is empty."""
    zero = F.struct(*[F.lit(0).alias(n) for n in ("best", "begin", "end", "sum", "start", "at")])

    def step(a: Column, block: Column) -> Column:
        anew = a["sum"] < 0
        total = F.when(anew, block["score"]).otherwise(a["sum"] + block["score"])
        start = F.when(anew, a["at"]).otherwise(a["start"])
        better = total > a["best"]
        return F.struct(
            F.when(better, total).otherwise(a["best"]).alias("best"),
            F.when(better, start).otherwise(a["begin"]).alias("begin"),
            F.when(better, a["at"] + 1).otherwise(a["end"]).alias("end"),
            total.alias("sum"), start.alias("start"), (a["at"] + 1).alias("at"),
        )

    return F.aggregate(blocks, zero, step)


def main_block(html: Column) -> Column:
    """Text of the page's main part, a block per line.

    The page is cut where block elements begin or end. A block is worth its text
    outside links, less its text in links and a fixed cost, more or less what its
    tag tells; the main part is the run of blocks with the largest sum. A page
    without a run worth anything has an empty text.
    """
    page = F.regexp_replace(html, SILENT_PATTERN, " ")
    pieces = F.split(F.regexp_replace(page, BLOCK_TAG, f"{BLOCK_MARK}$1"), BLOCK_MARK)

    def chosen(blocks: Column) -> Column:
        return let(_best_run(blocks), lambda run: F.slice(blocks["text"], run["begin"] + 1, run["end"] - run["begin"]))

    lines = let(F.transform(pieces, _scored_block), chosen)
    text = decode_entities(F.array_join(F.filter(lines, lambda x: x != ""), "\n"))
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f]+", " "), r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def blocks(text: Column) -> Column:
    """The lines of extracted text, in order."""
    return F.split(text, "\n")


def container_pattern(tag: str, css_class: str | None = None) -> str:
    """Pattern whose group 1 is the content of ``tag`` elements (of one class)."""
    attributes = r"(?:\s[^>]*)?"
    if css_class is not None:
        named = rf"""(?:[^"'>]*\s)?{css_class}(?:\s[^"'>]*)?"""
        attributes = rf"""\s(?:[^>]*\s)?class\s*=\s*(?:"{named}"|'{named}')[^>]*"""
    return rf"(?is)<{tag}{attributes}>(.*?)(?:</{tag}\s*>|\z)"


def anchors(html: Column, container: str) -> Column:
    """Array of (href, anchor) for the links inside matching containers.

    The content is cut where anchors start, as anchors do not nest: one left
    open ends at the next.
    """
    inside = F.array_join(F.regexp_extract_all(html, F.lit(container), F.lit(1)), " ")
    pieces = F.split(inside, ANCHOR_START)
    linked = F.filter(F.slice(pieces, F.lit(2), F.size(pieces)), lambda x: x.rlike(HREF_PATTERN))
    return F.transform(
        linked,
        lambda x: F.struct(
            F.btrim(F.regexp_extract(x, HREF_PATTERN, 1), F.lit("\"'")).alias("href"),
            decode_entities(strip_tags(F.regexp_extract(x, ANCHOR_CONTENT, 1))).alias("anchor"),
        ),
    )
