"""String columns: accents, encoding repair, page keys."""

import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import functions as F

from tunetrail.schema import ARTIST_ALIASES, KEY_PUNCTUATION

HANGUL = range(0xAC00, 0xD7A4)
LATIN_END = 0x250


@lru_cache(maxsize=None)
def _folds():
    """(one-to-one folds, one-to-many folds, combining marks), from Python's Unicode tables.

    Hangul syllables are not among them: `_jamo` takes those apart by arithmetic.
    """
    single, multi, marks = {}, {}, []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if unicodedata.combining(char):
            marks.append(code)
        elif unicodedata.decomposition(char) and code not in HANGUL:
            plain = "".join(x for x in unicodedata.normalize("NFKD", char) if not unicodedata.combining(x))
            if not plain:  # some vowel signs are nothing but marks
                marks.append(code)
            elif len(plain) == 1 and plain != char:
                single[char] = plain
            elif len(plain) > 1:
                multi[char] = plain
    return single, multi, marks


def literal_map(pairs):
    """A constant string map, sent to Spark as one literal."""
    text = "\u0002".join(f"{k}\u0001{v}" for k, v in pairs.items())
    return F.str_to_map(F.lit(text), F.lit("\u0002"), F.lit("\u0001"))


def _char_class(codes):
    """Regex class of code points, as ranges."""
    spans = []
    for code in sorted(codes):
        if spans and code == spans[-1][1] + 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans) + "]"


def _jamo(char):
    """The two or three letters of a Hangul syllable, by the arithmetic of its code point; NULL for other characters."""
    letters = lambda first, n: F.lit("".join(chr(first + k) for k in range(n)))
    place = F.ascii(char) - HANGUL.start
    vowel, final = F.floor(place / 28) % 21, place % 28
    pick = lambda text, at: F.substr(text, at.cast("int") + 1, F.lit(1))
    return F.when(F.ascii(char).between(HANGUL.start, HANGUL.stop - 1), F.concat(
        pick(letters(0x1100, 19), F.floor(place / 588)), pick(letters(0x1161, 21), vowel),
        F.when(final > 0, pick(letters(0x11A7, 28), final)).otherwise("")))


def strip_accents(c):
    """Compatibility-decompose and drop combining marks, without leaving the JVM.

    ASCII text is kept as it is, Latin text folds character by character (`translate`). Other
    text also has its marks removed, and the characters that fold to several (ligatures,
    fractions) looked up and Hangul syllables taken apart.
    """
    single, multi, marks = _folds()
    latin_multi = [ord(m) for m in multi if ord(m) < LATIN_END]
    beyond = _char_class(latin_multi)[:-1] + rf"\x{{{LATIN_END:X}}}-\x{{10FFFF}}]"
    latin_map = {a: b for a, b in single.items() if ord(a) < LATIN_END}

    table = literal_map(multi)
    one_by_one = F.transform(F.split(c, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), _jamo(ch), ch))
    spread = F.when(c.rlike(_char_class([*map(ord, multi), *HANGUL])), F.array_join(one_by_one, "")).otherwise(c)
    other = F.regexp_replace(F.translate(spread, "".join(single), "".join(single.values())), _char_class(marks), "")
    return (F.when(~c.rlike(r"[\x{80}-\x{10FFFF}]"), c)
            .when(~c.rlike(beyond), F.translate(c, "".join(latin_map), "".join(latin_map.values())))
            .otherwise(other))


def fix_mojibake(c, strip_escapes=False):
    """Re-read latin-1 bytes as UTF-8 where that is possible, else keep the text.

    Only text with a lead byte before a continuation byte can be UTF-8, and only text without
    wider characters has latin-1 bytes. `strip_escapes` first blanks `_x000d_` and literal
    `\\n` / `\\r`, and turns NULL into ''.
    """
    if strip_escapes:
        c = F.regexp_replace(c, r"(?i)_x000d_|\\n|\\r", " ")
    candidate = c.rlike(r"[\x{C2}-\x{F4}][\x{80}-\x{BF}]") & ~c.rlike(r"[^\x{00}-\x{FF}]")
    read_again = F.when(candidate, F.encode(c, "ISO-8859-1").cast("string"))
    fixed = F.coalesce(F.try_validate_utf8(read_again), c)
    return F.coalesce(fixed, F.lit("")) if strip_escapes else fixed


def trim_all(c):
    """Trim every kind of white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def artist_key(c, aliases=None):
    """Artist part of a page address."""
    aliases = ARTIST_ALIASES if aliases is None else aliases
    name = trim_all(F.lower(strip_accents(c)))
    key = F.regexp_replace(name, "^the ", "")
    key = F.translate(key, "$ " + KEY_PUNCTUATION, "s")
    if not aliases:
        return key
    table = literal_map(aliases)
    return F.coalesce(F.try_element_at(table, name), key)


def title_key(c):
    """Title part of a page address."""
    t = strip_accents(c)
    t = F.regexp_replace(t, r"\(([^)]*)\)", " $1 ")
    t = F.regexp_replace(t, r"\[[^\]]*\]", "")
    t = F.regexp_replace(t, r"(?iU)\b(feat\.?|ft\.?|featuring)\b[^\n]*", "")
    t = F.regexp_replace(t, r"-[^\n]*$", "")
    t = F.translate(F.lower(t), KEY_PUNCTUATION + "#", "")
    return F.regexp_replace(t, r"(?U)\s+", "")


def page_url(artist, title, pattern):
    """Fill a `…%s…%s…` address pattern with the two keys."""
    return F.format_string(pattern, artist_key(artist), title_key(title))


def title_case(c):
    """Upper-case the first letter after any non-letter, lower-case the others."""
    marked = F.regexp_replace(F.lower(c), r"([^\p{L}\s])(\p{L})", "$1\u0001 $2")
    return F.regexp_replace(F.initcap(marked), "\u0001 ", "")


def strip_prefix(c, prefix):
    return F.regexp_replace(c, "^" + re.escape(prefix), "")
