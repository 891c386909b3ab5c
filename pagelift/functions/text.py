"""Text expressions (D9, Q1-Q7, A6) as built-in Column expressions.

Python's whitespace (``str.split``/``str.strip``/``re`` ``\\s``) is wider than
Java's ``\\s``; the class below is the set of characters Python treats as
whitespace, written so that both Java regex and RE2 (the DuckDB oracle) accept
it.  ``splitlines`` boundaries likewise.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's whitespace characters and line boundaries.
WS = (r"[\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

# The same sets in the form that Java's engine tests fastest: Latin-1 characters one by one (a bit set), the others behind
# one range that rules out most letters, and a break that begins with a single class.
_WS = (r"[\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0[\x{1680}-\x{3000}&&"
       r"[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]")
_WS_CHARS = "".join(map(chr, [*range(9, 14), *range(0x1c, 0x21), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b), 0x2028, 0x2029, 0x202f, 0x205f, 0x3000]))
_BREAK = r"[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}-\x{2029}](?:(?<=\r)\n)?"
#: White space that is not a single blank already.
_UNEVEN = rf"{_WS}(?:{_WS}+|(?<! ))"

# Quality terms and weights (content_quality).
BOILERPLATE_TERMS = (
    "accept cookies",
    "privacy policy",
    "sign up",
    "all rights reserved",
    "enable javascript",
)
SENTENCE_MARKS = ".?!:"
REPEAT_MIN_CHARS = 40
REPEAT_PENALTY = 40


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """``str.strip()``: remove leading/trailing Python whitespace."""
    return F.btrim(_c(col), F.lit(_WS_CHARS))


def collapse_ws(col) -> Column:
    """``re.sub(r"\\s+", " ", s).strip()``."""
    return py_strip(squeeze_ws(col))


def squeeze_ws(col) -> Column:
    """``re.sub(r"\\s+", " ", s)`` without the strip."""
    return F.regexp_replace(_c(col), _UNEVEN, " ")


def words(col) -> Column:
    """Q1: ``s.split()`` -- whitespace-separated words, no empties."""
    return F.array_remove(F.split(_c(col), f"{_WS}+"), "")


def word_count(col) -> Column:
    """``len(s.split())``."""
    return F.size(words(col))


def lines(col) -> Column:
    """``s.splitlines()`` (a trailing empty piece is harmless for all users)."""
    return F.split(_c(col), _BREAK)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _folds() -> tuple[str, str, dict[str, str]]:
    """What case folding does to characters that are lower case already, by the Unicode rules of the
    standard library: one-to-one as two strings, one-to-many as a map."""
    lower = [c for c in map(chr, range(0x10000)) if c == c.lower() and c != c.casefold() and not 0xD800 <= ord(c) < 0xE000]
    single = [c for c in lower if len(c.casefold()) == 1]
    return "".join(single), "".join(c.casefold() for c in single), {c: c.casefold() for c in lower if len(c.casefold()) > 1}


_FOLD_FROM, _FOLD_TO, _FOLD_LONG = _folds()


def _class(chars) -> str:
    """A pattern for one of the characters, neighbours as ranges."""
    points, spans = sorted(map(ord, chars)), []
    for p in points:
        if spans and spans[-1][1] == p - 1:
            spans[-1][1] = p
        else:
            spans.append([p, p])
    (low, end), *rest = spans  # what lies between the first span and the last is ruled out by one comparison
    inner = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in rest)
    return rf"[\x{{{low:x}}}-\x{{{end:x}}}[\x{{{rest[0][0]:x}}}-\x{{{rest[-1][1]:x}}}&&[{inner}]]]" if rest else rf"[\x{{{low:x}}}-\x{{{end:x}}}]"


def casefold(col) -> Column:
    """``str.casefold()``: lower case, then the folds that lower case leaves; a text is touched only if it holds a
    character that folds, and spelled out character by character only if one folds to several."""
    table = F.from_json(F.lit(json.dumps(_FOLD_LONG)), "map<string,string>")

    def folded(low: Column) -> Column:
        single = F.translate(low, _FOLD_FROM, _FOLD_TO)
        spelled = F.array_join(F.transform(F.split(single, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
        return (F.when(~low.rlike(_class([*_FOLD_FROM, *_FOLD_LONG])), low)
                .when(low.rlike(_class(_FOLD_LONG)), spelled).otherwise(single))

    # sharp s is common and has a way of its own
    return let(F.replace(F.lower(_c(col)), F.lit("ß"), F.lit("ss")), folded)


def structure_lines(col) -> Column:
    """Q3: lines whose left-stripped form starts with # - * or |.

    One match a line: white space before the mark may hold further breaks, but
    those end blank lines only."""
    return F.regexp_count(_c(col), F.lit(rf"(?:^|{_BREAK}){_WS}*[#\-*|]"))


def sentence_marks(col) -> Column:
    """Q4: count of . ? ! : characters."""
    c = _c(col)
    return F.length(c) - F.length(F.translate(c, SENTENCE_MARKS, ""))


def _hits(folded: Column) -> Column:
    return sum((F.regexp_count(folded, F.lit(t)) for t in BOILERPLATE_TERMS), F.lit(0)).cast("long")


def boilerplate_hits(col) -> Column:
    """Q5: non-overlapping occurrences of the boilerplate terms, case-folded."""
    return let(casefold(col), _hits)


def repeated_line_penalty(col) -> Column:
    """Q6: 40 points per repeat of a stripped line longer than 40 chars."""
    long_lines = F.filter(F.transform(lines(col), py_strip), lambda ln: F.length(ln) > REPEAT_MIN_CHARS)
    return let(long_lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))) * REPEAT_PENALTY)


def quality_of(text: Column) -> Column:
    """Q7: ``content_quality`` as one expression (also inside higher-order
    functions) -- evaluated in the same order as the reference arithmetic so
    that doubles are bit-identical."""
    def scored(w: Column) -> Column:
        n = F.size(w)
        ints = (F.least(n, F.lit(2000)) + F.least(structure_lines(text), F.lit(30)) * 8
                + F.least(sentence_marks(text), F.lit(100)) * 2)
        distinct = lambda folded: F.size(F.array_distinct(words(folded)))
        points = lambda folded: (
            ints.cast("double") + F.try_divide(distinct(folded).cast("double"), n.cast("double")) * 100.0
            - (_hits(folded) * 80).cast("double") - repeated_line_penalty(text).cast("double"))
        return F.when(n == 0, F.lit(0.0)).otherwise(let(casefold(text), points))
    return let(words(text), scored)


def quality(col) -> Column:
    """Q7 of a column."""
    return quality_of(_c(col))


def with_quality(df, text: str, out: str = "quality", features: bool = False):
    """Q1-Q7 as a chain of projections: the text is folded and split once into
    columns that every feature reads.  Adds ``out`` (and, with ``features``, the
    Q1-Q6 columns)."""
    t = F.col(text)
    df = df.withColumn("_q_words", words(t)).withColumn("_q_folded", casefold(t))
    df = df.select("*", F.size("_q_words").alias("_q_n"), F.size(F.array_distinct(words("_q_folded"))).alias("_q_distinct"),
                   structure_lines(t).alias("_q_struct"), sentence_marks(t).alias("_q_marks"),
                   _hits(F.col("_q_folded")).alias("_q_boiler"), repeated_line_penalty(t).alias("_q_penalty"))
    n, penalty = F.col("_q_n"), F.col("_q_penalty")
    ints = (F.least(n, F.lit(2000)) + F.least(F.col("_q_struct"), F.lit(30)) * 8
            + F.least(F.col("_q_marks"), F.lit(100)) * 2)
    ratio = F.try_divide(F.col("_q_distinct").cast("double"), n.cast("double"))
    score = (ints.cast("double") + ratio * 100.0 - (F.col("_q_boiler") * 80).cast("double")
             - penalty.cast("double"))
    df = df.withColumn(out, F.when(n == 0, F.lit(0.0)).otherwise(score))
    if features:
        df = df.select("*", *(F.col(c).cast("long").alias(name) for c, name in (
            ("_q_n", "n_words"), ("_q_struct", "structure_lines"), ("_q_marks", "sentence_marks"),
            ("_q_boiler", "boilerplate_hits"), ("_q_penalty", "repeat_penalty"))))
    return df.drop("_q_words", "_q_folded", "_q_n", "_q_distinct", "_q_struct", "_q_marks", "_q_boiler", "_q_penalty")
