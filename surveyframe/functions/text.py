"""Normalisation and predicates of questionnaire texts, as native column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that stripping and splitting know, inside a character class.
WS_SET = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{WS_SET}]"
# What makes a question conditional; searched without regard to case.
CONDITIONAL = [
    r"\bif\s+(?:yes|no|not|any|so|applicable|relevant|available)\b",
    r"\bif\s+the\s+(?:answer|above|previous|preceding)\b",
    r"\bif\s+applicable\b",
    r"\bwhere\s+applicable\b",
    r"\bonly\s+if\b",
    r"\b(?:answer|complete|fill|provide|specify)\b[^.?!]*\bif\b",
    r"\bskip\s+if\b",
    r"\bleave\s+blank\s+if\b",
    r"\b(?:otherwise|else)\s+(?:leave|skip|n/?a)\b",
    r"\(\s*if\s+[^)]*\)",
    r"\bplease\s+answer\b[^.?!]*\b(?:no|yes)\b",
]
# Cell texts that a table reader takes for missing.
NA_STRINGS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
#: Leading numbering, as often as it repeats: "Q1.", "Question 3 -", "1.2", "a)". Possessive, so that the match is a loop and needs no stack.
NUMBERING = f"^(?i)(?:{WS}*(?:q(?:uestion)?{WS}*[\\-.]?{WS}*)?\\p{{Nd}}+[).:\\-]?{WS}*|{WS}*[a-z][).:]{WS}*)++"
DIGIT_RUNS = r"(\p{Nd}+)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space of any kind on either side; null stays null."""
    return F.regexp_replace(_c(x), f"^{WS}+|{WS}+\\z", "")


def collapse(x: Column | str) -> Column:
    """Each run of white space as one space, none on either side."""
    return F.trim(F.regexp_replace(_c(x), f"{WS}+", " "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, list[tuple[str, str]]]:
    """Where case folding differs from lower case: single characters, and those that become several."""
    single, several = [], []
    for i in range(0x110000):
        if 0xD800 <= i < 0xE000:
            continue
        low = chr(i).lower()
        if len(low) == 1 and low == chr(i) and (folded := low.casefold()) != low:
            (single if len(folded) == 1 else several).append((low, folded))
    return "".join(a for a, _ in single), "".join(b for _, b in single), several


def casefold(x: Column | str) -> Column:
    """Lower case for comparison. Only texts with one of the rarer characters take the long way."""
    single, to, several = _fold_tables()
    rare = [pair for pair in several if pair[0] != "ß"]
    special = sorted("".join(a for a, _ in rare) + single)
    beyond = [c for c in special if c < "\u0100"]

    def fold(low: Column) -> Column:
        folded = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), rare, F.translate(low, single, to))
        # Nearly all texts are ruled out by two ranges; the long class is tried on the others.
        can = low.rlike(f"[{''.join(beyond)}{next(c for c in special if c >= '\u0100')}-{special[-1]}]")
        return F.when(~can, low).when(low.rlike(f"[{''.join(special)}]"), folded).otherwise(low)

    return let(F.replace(F.lower(_c(x)), F.lit("ß"), F.lit("ss")), fold)


def is_blank(x: Column | str, extra: list[str] | None = None) -> Column:
    """Null, empty, white space alone, or one of the placeholders whatever its case."""
    text = F.coalesce(strip(x), F.lit(""))
    blank = text == ""
    words = sorted({w.strip().casefold() for w in extra or []} - {""})
    return blank | casefold(text).isin(words) if words else blank


def non_blank(x: Column | str) -> Column:
    """The stripped text, null if there is none."""
    return F.nullif(strip(x), F.lit(""))


def first_line(x: Column | str) -> Column:
    return F.substring_index(_c(x), "\n", 1)


def match_key(x: Column | str) -> Column:
    """First line, white space collapsed, lower case; null becomes ''."""
    return F.lower(collapse(first_line(F.coalesce(_c(x), F.lit("")))))


def norm_match(x: Column | str) -> Column:
    """Without leading numbering and punctuation, white space collapsed, folded: equal for texts that differ in form only."""
    text = F.regexp_replace(F.coalesce(_c(x), F.lit("")), NUMBERING, "")
    return casefold(collapse(F.regexp_replace(text, f"[^\\p{{L}}\\p{{N}}_{WS_SET}]", " ")))


def normalise(x: Column | str) -> Column:
    """White space collapsed, folded; null becomes ''."""
    return casefold(collapse(F.coalesce(_c(x), F.lit(""))))


def joined(*parts: Column | str, sep: str = " - ") -> Column:
    """The non-blank parts, stripped, joined; '' if there are none."""
    return F.concat_ws(sep, *[non_blank(p) for p in parts])


def display_question(label: Column | str, prompt: Column | str) -> Column:
    """The label, if any, and the first line of the prompt."""
    return joined(label, first_line(F.coalesce(_c(prompt), F.lit(""))))


def append_line(a: Column | str, b: Column | str) -> Column:
    """a and b on lines of their own, stripped; b unchanged if a is empty."""
    return F.when(F.coalesce(_c(a), F.lit("")) == "", _c(b)).otherwise(strip(F.concat_ws("\n", _c(a), _c(b))))


def conditional_pattern(extra: list[str] | None = None) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in [*CONDITIONAL, *(extra or [])])


def is_conditional(x: Column | str, extra: list[str] | None = None) -> Column:
    """Whether the question's text says that it needn't be answered always."""
    return F.coalesce(_c(x).rlike(conditional_pattern(extra)), F.lit(False))


def digit_runs(x: Column | str) -> Column:
    """All runs of digits as numbers, [10^9] without any: sorts Q2 before Q10. Longer runs than 18 digits are cut to the largest number; ``digit_order`` sorts them, too."""
    runs = F.transform(F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(DIGIT_RUNS), 1), lambda d: F.coalesce(d.try_cast("bigint"), F.lit((1 << 63) - 1)))
    return F.when(F.size(runs) > 0, runs).otherwise(F.array(F.lit(10**9).cast("bigint")))


def digit_order(x: Column | str) -> Column:
    """What sorts ids by all their runs of digits as numbers, however long: for each run its digits without leading zeros, shorter
    ones first; ids without any as if they had 10^9. Digits of any script count."""
    found = F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(DIGIT_RUNS), 1)
    runs = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(str(10**9))))
    plain = lambda d: F.regexp_replace(F.translate(d, *_digit_table()), "^0+(?=.)", "")
    return F.transform(F.transform(runs, plain), lambda d: F.struct(F.length(d).alias("length"), d.alias("digits")))


@lru_cache(maxsize=1)
def _digit_table() -> tuple[str, str]:
    """All decimal digits beyond ASCII, and their values."""
    others = [chr(i) for i in range(0x80, 0x20000) if chr(i).isdecimal()]
    return "".join(others), "".join(str(int(c)) for c in others)


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, rounded half away from zero; null if whole is 0."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def safe_filename(x: Column | str) -> Column:
    """Without characters that file systems refuse; 'sheet' if nothing is left."""
    return F.coalesce(non_blank(F.regexp_replace(_c(x), r'[/\\:*?"<>|]+', "_")), F.lit("sheet"))


def column_letters(n: Column | str) -> Column:
    """A..XFD for 1..16384; null outside."""
    n = _c(n).cast("int")

    def letter(x: Column) -> Column:
        return F.char(x % 26 + 65)

    one, two, three = n - 1, n - 27, n - 703
    return (
        F.when((n < 1) | (n > 16384), F.lit(None).cast("string"))
        .when(n <= 26, letter(one))
        .when(n <= 702, F.concat(letter(F.floor(two / 26)), letter(two)))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26)), letter(three)))
    )


def column_number(letters: str) -> int:
    """1 for A, 40 for AN."""
    return reduce(lambda n, c: n * 26 + ord(c) - 64, letters.upper(), 0)


def fill_class(rgb: Column | str, fill_type: Column | str | None = None) -> Column:
    """'grey', 'green', 'yellow' or 'none' by the last six hex digits of an explicit colour. The order decides."""
    rgb = _c(rgb)
    part = lambda at: F.conv(F.substr(rgb, F.length(rgb) - at, F.lit(2)), 16, 10).cast("int")
    r, g, b = part(5), part(3), part(1)
    grey = (F.abs(r - g) < 20) & (F.abs(g - b) < 20) & r.between(150, 245)
    green = (g > r + 10) & (g > b + 10) & (g >= 150)
    yellow = (r >= 200) & (g >= 180) & (b < 170) & (F.abs(r - g) < 60)
    known = rgb.rlike("[0-9A-Fa-f]{6}\\z")
    known = known if fill_type is None else known & (_c(fill_type) == "rgb")
    return F.when(~F.coalesce(known, F.lit(False)), "none").when(grey, "grey").when(green, "green").when(yellow, "yellow").otherwise("none")


def is_section_header(text: Column | str, bold: Column | str, size: Column | str) -> Column:
    """Bold, 12 points or more (11 if unset), more than four characters, upper case with a letter."""
    text = _c(text)
    big = F.coalesce(F.nullif(_c(size), F.lit(0.0)), F.lit(11.0)) >= 12
    upper = (text == F.upper(text)) & (text != F.lower(text)) & (F.length(text) > 4)
    return F.coalesce(_c(bold) & big & upper, F.lit(False))


def question_id(text: Column | str) -> Column:
    """'Q<digits>' if that is all the text says, else null."""
    return F.nullif(F.regexp_extract(strip(text), r"^(Q\p{Nd}+)\z", 1), F.lit(""))
