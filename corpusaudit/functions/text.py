r"""String expressions. Python's notions of whitespace, lines and words, as Spark columns.

``str.strip`` removes Unicode white space (Spark's ``trim`` removes only the space), ``splitlines``
breaks on more than ``\n``, and ``\w`` covers all letters and digits; the helpers name those
classes explicitly so that results do not depend on the regex dialect.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes of the strip / splitlines / word rules.
SPACE_CLASS = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
WORD = r"[\p{L}\p{N}_]+"
NO_WORD = r"[^\p{L}\p{N}_]+"
LETTER = r"[a-z0-9_\p{L}\p{N}]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(col: Column) -> Column:
    """Remove leading and trailing Unicode white space."""
    return F.btrim(col, F.lit(SPACES))


def split_lines(col: Column) -> Column:
    return F.split(col, LINE_BREAK)


def word_count(col: Column) -> Column:
    """Number of maximal runs of letters, digits and underscore."""
    return F.regexp_count(col, F.lit(WORD)).cast("bigint")


def collapse_whitespace(col: Column) -> Column:
    return strip(F.regexp_replace(col, f"[{SPACE_CLASS}]+", " "))


def drop_brackets(col: Column) -> Column:
    """Remove [bracketed] citations with the white space around them."""
    return F.regexp_replace(col, r"\s*\[.*?\]\s*", "")


def drop_parentheses(col: Column) -> Column:
    return F.regexp_replace(col, r"\s*\([^)]*\)", "")


def without_parentheses(col: Column) -> Column:
    """Remove (remarks) with the white space around them, and white space at the ends."""
    return strip(F.regexp_replace(col, r"\s*\(.*?\)\s*", ""))


def first_line(col: Column) -> Column:
    return F.get(F.split(col, "\n"), F.lit(0))


def first_lines(col: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(col, "\n"), 1, n), "\n")


def title_case(col: Column) -> Column:
    """Every run of letters starts with a capital, the rest is lower case."""
    runs = F.split(col, r"(?<!\p{L})(?=\p{L})")
    return F.array_join(
        F.transform(
            runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))
        ),
        "",
    )


def title_with_synonyms(col: Column, synonyms: Mapping[str, str]) -> Column:
    """Title-case a label, then replace known synonyms."""
    return let(title_case(col), lambda t: lookup(t, synonyms))


def lookup(col: Column, mapping: Mapping[str, str], default: Column | None = None) -> Column:
    """Value of a short literal mapping, else ``default`` (the key itself if none is given)."""
    fallback = col if default is None else default
    if not mapping:
        return fallback
    out = None
    for key, value in mapping.items():
        hit = col == F.lit(key)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(fallback)


def is_list_literal(col: Column) -> Column:
    return strip(col).rlike(r"(?s)^\[.*\]$")


def list_literal(col: Column) -> Column:
    """``['a', 'b']`` written as text becomes an array; any other text becomes a one-item array.

    Items may be in single or double quotes, which then may hold commas and escaped quotes, or bare. An empty list has no items; a NULL
    becomes an array of one NULL.
    """
    found = F.regexp_extract_all(
        F.regexp_replace(strip(col), r"^\[|\]$", ""), F.lit(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^,'"\s][^,]*"""), F.lit(0)
    )

    def unquoted(item: Column) -> Column:
        bare = F.regexp_replace(item, r"""^(['"])(.*)\1$""", "$2")
        return F.regexp_replace(bare, r"""\\(['"\\])""", "$1")

    items = F.filter(F.transform(found, lambda x: unquoted(strip(x))), lambda x: x != "")
    return F.when(is_list_literal(col), items).otherwise(F.array(col))


def split_label(col: Column, index: int, sep: str = " | ") -> Column:
    """One field of a ``a | b`` label."""
    return F.get(F.split(col, sep.replace("|", "[|]")), F.lit(index))


def shorten(col: Column, width: int) -> Column:
    return F.when(F.length(col) > width, F.concat(F.substring(col, 1, width), F.lit("..."))).otherwise(col)


def fold_case(col: Column) -> Column:
    """Lower case, with the long s as s, so that plain comparison ignores case."""
    return F.replace(F.lower(col), F.lit("\u017f"), F.lit("s"))


def _heads(keywords: Iterable[str]) -> tuple[list[str], list[str], list[str]]:
    """Keywords that are one word, phrases, and the first words of the phrases."""
    wanted = list(dict.fromkeys(k.lower() for k in keywords))
    single = [k for k in wanted if re.fullmatch("[a-z0-9_]+", k)]
    phrases = [k for k in wanted if k not in single]
    return single, phrases, [re.match("[a-z0-9_]*", p)[0] for p in phrases]


def has_whole_word(folded: Column, keywords: Iterable[str], asked: Iterable[str] | None = None) -> Column:
    """Does a case-folded text contain any keyword between word boundaries?

    The text's words are looked up in the keywords that are one word; a phrase is searched only in texts with its first word. With
    ``asked``, all keywords of several such questions on one text, its words are cut and looked up once for all of them.
    """
    single, phrases, heads = _heads(keywords)
    every = [single, heads] if asked is None else _heads(asked)[::2]
    text_array = lambda some: F.array(*[F.lit(k) for k in some]).cast("array<string>")
    words = F.array_intersect(F.split(folded, NO_WORD), text_array(dict.fromkeys(k for part in every for k in part)))
    spoken = F.lit(False)
    for phrase in phrases:
        bounded = f"(?<!{LETTER}){re.escape(phrase)}(?!{LETTER})"
        spoken = spoken | (F.contains(folded, F.lit(phrase)) & folded.rlike(bounded))
    return F.arrays_overlap(words, text_array(single)) | (F.arrays_overlap(words, text_array(heads)) & spoken)


def slug(col: Column) -> Column:
    """Language name as an identifier: lower case, runs of other characters become ``-``."""
    return F.regexp_replace(F.regexp_replace(F.lower(col), r"[^a-z0-9+#]+", "-"), "^-|-$", "")


def language_base(col: Column) -> Column:
    """``en-US`` and ``en_US`` become ``en``."""
    return F.regexp_extract(col, "^[^-_]*", 0)


def number_or_null(col: Column) -> Column:
    return col.cast("string").try_cast("double")


def duration_label(seconds: Column) -> Column:
    """Seconds as ``1h 02m``."""
    return F.format_string("%dh %02dm", F.floor(seconds / 3600), F.floor((seconds % 3600) / 60))


def percent_label(value: Column, digits: int = 1) -> Column:
    """``12.5 %``; halves go to the even digit."""
    return F.format_string(f"%.{digits}f %%", F.bround(value, digits))
