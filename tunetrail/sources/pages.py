"""Lyrics text out of archived pages."""

from html.entities import name2codepoint

from pyspark.sql import functions as F

from tunetrail.functions.text import literal_map, trim_all

#: Elements without content.
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
BLOCK_TAGS = ("div", "p", "article", "section", "td", "li", "main", "body")
SKIPPED_TAGS = ("script", "style", "nav")


def unescape(c):
    """Decode named and numeric character references; unknown ones stay as they are."""
    names = literal_map({n: chr(code) for n, code in name2codepoint.items()})

    def decoded(part):
        name = F.regexp_extract(part, r"^(#?\w+);", 1)
        digits = F.regexp_extract(name, r"^#([0-9]{1,7})$", 1).try_cast("int")
        hexed = F.conv(F.nullif(F.regexp_extract(name, r"(?i)^#x([0-9a-f]{1,6})$", 1), F.lit("")), 16, 10).try_cast("int")
        code = F.coalesce(digits, hexed)
        code = F.when((code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF), code)
        char = F.coalesce(F.try_element_at(names, name),
                          F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.coalesce(F.concat(char, F.substr(part, F.length(name) + 2)), F.concat(F.lit("&"), part))

    parts = F.split(c, "&")
    return F.when(~F.contains(c, F.lit("&")), c).otherwise(
        F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(decoded(p))), ""))


def plain_block(body):
    """Text of the second `div` without a class, text pieces on lines of their own; NULL with fewer."""
    divs = F.regexp_extract_all(body, F.lit(r"(?is)<div\b[^>]*>.*?</div>"), F.lit(0))
    plain = F.filter(divs, lambda d: ~d.rlike(r"(?i)^<div\b[^>]*\bclass\s*="))
    return F.regexp_replace(F.get(plain, F.lit(1)), r"(<[^>]*>)+", "\n")


def extract_page_lyrics(pages, html="html", block_tags=BLOCK_TAGS, prefer_plain=False):
    """Add `lyrics` and `n_br`: the text block with the most line breaks, first on ties.

    Every step works inside the row, so nothing is shuffled; pages whose blocks hold no
    line break get NULL. With `prefer_plain` the second class-less `div` is taken where a page
    has two of them.
    """
    body = F.regexp_replace(F.col(html), r"(?s)<!--.*?-->", "")
    for tag in SKIPPED_TAGS:
        body = F.regexp_replace(body, rf"(?is)<{tag}\b.*?</{tag}>", "")
    tags = "|".join(block_tags)
    blocks = F.split(body, rf"(?i)</?(?:{tags})\b[^>]*>")
    breaks = lambda b: F.regexp_count(b, F.lit(r"(?i)<br\b"))
    ranked = F.transform(blocks, lambda b, i: F.struct(
        breaks(b).alias("n_br"), (-i).alias("order"), b.alias("block")))
    best = pages.withColumn("_best", F.array_max(ranked))
    text = F.regexp_replace("_best.block", r"(?i)<br\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    found = best.withColumn("n_br", F.col("_best.n_br")).withColumn("_text", text)
    lyrics = F.when(F.col("n_br") > 0, F.nullif(trim_all(unescape(F.col("_text"))), F.lit("")))
    if prefer_plain:
        lyrics = F.coalesce(trim_all(unescape(plain_block(body))), lyrics)
    return (found.withColumn("lyrics", lyrics)
            .drop("_best", "_text"))


NODES = ("stack array<string>, content int, first int, br int, open boolean, plain boolean, children int, plains int,"
         " best_br int, best_from int, best_to int, second_from int, second_to int")


def _pieces(html):
    """Tags and texts in order, without comments, declarations, scripts and styles."""
    body = F.regexp_replace(html, r"(?s)<!--.*?-->|<![^>]*>", "")
    for tag in ("script", "style"):
        body = F.regexp_replace(body, rf"(?is)<{tag}\b.*?</{tag}\s*>", "")
    return F.regexp_extract_all(body, F.lit(r"</?[A-Za-z][^>]*>|[^<]+|<"), F.lit(0))


def _closed(s, last):
    """State fields once the open child of the content block ends with piece `last`."""
    better = s["open"] & ((s["children"] == 0) | (s["br"] > s["best_br"]))
    plains = s["plains"] + (s["open"] & s["plain"]).cast("int")
    second = s["open"] & s["plain"] & (plains == 2)
    keep = lambda cond, value, name: F.when(cond, value).otherwise(s[name])
    return {"children": s["children"] + s["open"].cast("int"), "plains": plains, "open": F.lit(False),
            "best_br": keep(better, s["br"], "best_br"), "best_from": keep(better, s["first"], "best_from"),
            "best_to": keep(better, last, "best_to"), "second_from": keep(second, s["first"], "second_from"),
            "second_to": keep(second, last, "second_to")}


def _state(s, changes):
    names = [part.split()[0] for part in NODES.split(", ")]
    return F.struct(*(changes.get(n, s[n]).alias(n) for n in names)).cast(f"struct<{NODES.replace(' ', ': ').replace(',:', ',')}>")


def _step(content_class):
    """One piece of the fold: the stack of open elements, and the children of the content block."""

    def step(s, x):
        piece, at = x["piece"], x["at"]
        tag = F.lower(F.regexp_extract(piece, r"^</?([A-Za-z][^\s/>]*)", 1))
        is_tag = tag != ""
        closing, single = is_tag & piece.startswith("</"), tag.isin(*VOID_TAGS) | piece.endswith("/>")
        opening = is_tag & ~closing
        depth = F.size(s["stack"])
        back = F.array_position(F.reverse(s["stack"]), tag).cast("int")
        popped = F.when(closing & (back > 0), F.slice(s["stack"], F.lit(1), F.greatest(depth - back, F.lit(0)))).otherwise(
            F.when(opening & ~single, F.array_append(s["stack"], tag)).otherwise(s["stack"]))
        now = F.size(popped)
        inside, direct = s["content"] > 0, (s["content"] > 0) & (depth == s["content"])
        class_of = F.regexp_extract(piece, r"""(?i)\sclass\s*=\s*["']([^"']*)["']""", 1)
        found = (s["content"] == 0) & opening & ~single & (tag == "div") & (class_of == content_class)
        # A direct child begins: a text, or an element, which ends at once if it has no content.
        begins = direct & ~closing
        ends = inside & (begins & (~opening | single) | ~begins & s["open"] & closing & (now <= s["content"]))
        started = _state(s, {"open": begins | s["open"], "first": F.when(begins, at).otherwise(s["first"]),
                             "br": F.when(begins, 0).otherwise(s["br"] + (inside & opening & (tag == "br")).cast("int")),
                             "plain": F.when(begins, opening & (tag == "div") & ~piece.rlike(r"(?i)\sclass\s*=")).otherwise(s["plain"])})
        done = _closed(started, F.when(closing & (now < s["content"]), at - 1).otherwise(at))
        fields = {n: F.when(ends, v).otherwise(started[n]) for n, v in done.items()} | {
            n: started[n] for n in ("first", "br", "plain")}
        return _state(s, fields | {"stack": popped, "content": F.when(found, now).otherwise(
            F.when(inside & (now < s["content"]), -1).otherwise(s["content"]))})

    return step


def content_lyrics(pages, content_class, html="html"):
    """Add `lyrics`: text of the content block, the first `div` whose class is `content_class`.

    Nesting counts: an end tag closes the innermost element of its name with all in it. If two direct
    children are `div` without a class, it is the text of the second, nested ones included, its text
    pieces on lines of their own; else the text of the direct child (texts are children too) with the
    most `br` inside, the first on ties. NULL without such a block or with an empty text. One fold
    over the pieces of a page inside its row, linear in their number.
    """
    start = F.lit(None).cast(f"struct<{NODES.replace(' ', ': ').replace(',:', ',')}>")
    zero = {n: F.lit(0) for n in ("content", "first", "br", "children", "plains", "best_br", "best_from", "best_to",
                                  "second_from", "second_to")}
    start = _state(start, zero | {"stack": F.array().cast("array<string>"), "open": F.lit(False), "plain": F.lit(False)})
    split = pages.withColumn("_pieces", _pieces(F.col(html)))
    numbered = F.transform("_pieces", lambda p, i: F.struct(p.alias("piece"), i.alias("at")))
    folded = split.withColumn("_nodes", F.reduce(numbered, start, _step(content_class)))
    whole = F.struct(*(v.alias(n) for n, v in _closed(F.col("_nodes"), F.size("_pieces") - 1).items()))
    folded = folded.withColumn("_best", whole)
    text = lambda a, b: F.filter(F.slice("_pieces", a + 1, F.greatest(b - a + 1, F.lit(0))),
                                 lambda p: ~p.rlike(r"^</?[A-Za-z]"))
    second = F.array_join(text(F.col("_best.second_from"), F.col("_best.second_to")), "\n")
    best = F.array_join(text(F.col("_best.best_from"), F.col("_best.best_to")), "")
    found = F.when(F.col("_best.plains") >= 2, trim_all(unescape(second))).when(
        F.col("_best.children") > 0, F.nullif(trim_all(unescape(best)), F.lit("")))
    return folded.withColumn("lyrics", F.when(F.col("_nodes.content") != 0, found)).drop("_pieces", "_nodes", "_best")
