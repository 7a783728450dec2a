"""Text-cell expressions: blanks, numbers, percents, casing, shapes, names."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from tablesense import values as V

#: Every character Python's ``str.strip`` removes; Spark's ``trim`` removes spaces only.
WHITESPACE = "".join(
    chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                     *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
_SPACE = r"(?U)[\s\x1c-\x1f]+"
#: Decimal digits of other scripts, mapped to ASCII before a numeric parse.
_DIGIT_SCRIPTS = "".join(chr(z + i) for z in (0x0660, 0x06F0, 0x0966, 0x09E6, 0xFF10) for i in range(10))
#: One sign is removed; ``$`` goes before ``R$`` does, which leaves the R and no number.
_SYMBOLS = "(?:" + "|".join(r"\Q" + s + r"\E" for s in V.CURRENCY_SYMBOLS if s != "R$") + ")"
_TWO_SYMBOLS = rf"({_SYMBOLS[3:-1]}).*(?!\1){_SYMBOLS}"
#: Every character a number can be written with; prose fails at its first other letter.
_NUMBER_LETTERS = r"(?U)^[\s\x1c-\x1f\p{Nd}.,+()_eE৳$£€₹¥₦RTKktiInNfFyY-]+$"
_FLOAT = (
    r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
    r"|^[+-]?(?i:inf|infinity)$"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also when a lambda uses it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, _SPACE, " ")


def is_null_token(c: Column) -> Column:
    """A cell that says "no value": null, or one of the markers, trimmed, any case."""
    return c.isNull() | F.lower(strip(c)).isin(*V.NULL_TOKENS)


def normalise_text(c: Column) -> Column:
    """Trimmed text, with markers as null."""
    return F.when(~is_null_token(c), strip(c))


def is_zero_padded(c: Column) -> Column:
    return strip(c).rlike(r"^0\p{Nd}+$")


def currency_symbol(c: Column) -> Column:
    """The first symbol of the fixed list that occurs anywhere in the text."""
    return F.coalesce(*[F.when(c.contains(s), F.lit(s)) for s in V.CURRENCY_SYMBOLS])


def strip_currency(c: Column) -> Column:
    """Text without one currency symbol, spaces and thousands commas; ``(x)`` as ``-x``."""
    compact = F.regexp_replace(c, _SPACE, "")
    return _undecorated(let(compact, lambda k: F.replace(k, F.coalesce(currency_symbol(k), F.lit("")), F.lit(""))))


def _undecorated(text: Column) -> Column:
    signed = F.regexp_replace(text, r"^\((.*)\)$", "-$1")
    return F.regexp_replace(signed, r"(?<=\d),(?=\d{3}\b)", "")


def to_number(c: Column) -> Column:
    """Double, or null: one guarded cast, so no suffix letters are read as numbers."""
    bare = F.regexp_replace(F.translate(c, _DIGIT_SCRIPTS, "0123456789" * 5), rf"{_SPACE}|{_SYMBOLS}", "")
    number = F.regexp_extract(_undecorated(bare), _FLOAT, 0)
    readable = c.rlike(_NUMBER_LETTERS) & ~c.rlike(_TWO_SYMBOLS)
    return F.when(readable, F.replace(number, F.lit("_"), F.lit("")).try_cast("double"))


def to_plain_number(c: Column) -> Column:
    """Numbers as a cast reads them: no currency signs, commas or underscores."""
    text = strip(c.cast("string"))
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def to_boolean(c: Column, true: tuple[str, ...] = V.BOOLEAN_TRUE, false: tuple[str, ...] = V.BOOLEAN_FALSE) -> Column:
    word = F.lower(strip(c.cast("string")))
    return F.when(word.isin(*true), F.lit(True)).when(word.isin(*false), F.lit(False))


def parse_percent(c: Column) -> Column:
    text = strip(c)
    return F.when(
        text.rlike(r"^[-+]?[\d,]*\.?\d+\s*%$"), to_number(F.regexp_replace(text, "%+$", "")) / 100.0
    )


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every run of cased letters, lower the rest."""
    runs = F.regexp_extract_all(c, F.lit(r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"), F.lit(0))
    return F.array_join(
        F.transform(
            runs,
            lambda x: F.concat(F.upper(x.substr(F.lit(1), F.lit(1))), F.lower(x.substr(F.lit(2), F.length(x)))),
        ),
        "",
    )


def recase(c: Column, how: str) -> Column:
    return {"upper": F.upper, "lower": F.lower, "title": title_case, "strip": strip}[how](c)


def value_shape(c: Column) -> Column:
    """Letters as ``a``, digits as ``9``, number punctuation collapsed, 24 characters."""
    text = collapse_spaces(strip(c))
    text = F.regexp_replace(text, r"\p{L}+", "a")
    text = F.regexp_replace(text, r"\p{Nd}+", "9")
    return F.substring(F.regexp_replace(text, r"9([.,]9)+", "9"), 1, 24)


def safe_name(c: Column) -> Column:
    """A header label as a plain lower-case column name."""
    text = strip(collapse_spaces(c))
    for symbol, word in (("%", " pct "), ("&", " and "), ("#", " no ")):
        text = F.replace(text, F.lit(symbol), F.lit(word))
    text = F.regexp_replace(text, r"[^0-9a-zA-Z_]+", "_")
    text = F.btrim(F.regexp_replace(text, r"_{2,}", "_"), F.lit("_"))
    return F.lower(F.when(text.rlike(r"^\d"), F.concat(F.lit("c_"), text)).otherwise(text))


def _unmarked(code: int) -> str:
    return unicodedata.normalize("NFKD", chr(code).lower()).encode("ascii", "ignore").decode()


#: Lower-case Latin letters with marks and their plain forms (Spark has no decomposition).
_MARKED = [c for c in range(0xC0, 0x250) if chr(c) == chr(c).lower() and len(_unmarked(c)) == 1]
_ACCENTED = "".join(map(chr, _MARKED))
_PLAIN = "".join(map(_unmarked, _MARKED))


def sql_identifier(c: Column, fallback: str = "column") -> Column:
    """A legal unquoted SQL identifier of at most 63 characters."""
    text = F.translate(F.lower(strip(F.coalesce(c, F.lit("")))), _ACCENTED, _PLAIN)
    text = F.regexp_replace(text, r"[^\x00-\x7f]+", "")
    text = F.regexp_replace(text, r"[^a-z0-9_]+", "_")
    text = F.btrim(F.regexp_replace(text, r"_{2,}", "_"), F.lit("_"))
    text = F.when(text.rlike(r"^\d"), F.concat(F.lit("c_"), text)).otherwise(text)
    text = F.when(text.isin(*V.RESERVED_WORDS), F.concat(text, F.lit("_col"))).otherwise(text)
    text = F.rtrim(F.substring(text, 1, V.MAX_IDENTIFIER_LENGTH), F.lit("_"))
    return F.when(text == "", F.lit(fallback)).otherwise(text)


def humanise(c: Column) -> Column:
    spaced = F.regexp_replace(c, r"(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.lower(F.btrim(F.regexp_replace(spaced, r"[^0-9a-zA-Z]+", " ")))


def expand_abbreviations(c: Column) -> Column:
    pairs = [F.lit(x) for kv in V.ABBREVIATIONS.items() for x in kv]
    words = F.create_map(*pairs)
    return F.array_join(
        F.transform(F.split(c, " "), lambda t: F.coalesce(F.try_element_at(words, t), t)), " "
    )


def normalise_name(c: Column) -> Column:
    """The spelling used whenever two column names are compared."""
    return expand_abbreviations(humanise(c))


def normalise_question(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def _stem(word: Column) -> Column:
    out = word
    for suffix in reversed(V.STEM_SUFFIXES):
        n = len(suffix)
        out = F.when(
            word.endswith(suffix) & (F.length(word) - n >= 4),
            word.substr(F.lit(1), F.length(word) - n),
        ).otherwise(out)
    return out


def question_terms(c: Column) -> Column:
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    kept = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*V.STOPWORDS))
    return F.array_distinct(F.transform(kept, _stem))


def squeezed_name(c: Column) -> Column:
    """Letters and digits only, lower case: ``Total Amount`` and ``total_amount`` agree."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def name_runs(c: Column) -> Column:
    """Every run of 1 to 10 consecutive words, joined without spaces."""
    def runs(words: Column) -> Column:
        return F.flatten(F.transform(
            words,
            lambda _, s: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(V.MAX_NAME_WORDS), F.size(words) - s)),
                lambda n: F.array_join(F.slice(words, s + 1, n), ""),
            ),
        ))

    return let(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), runs)


def rename_words(c: Column, names: dict[str, str]) -> Column:
    """Replace whole-word names by a map, longest name first, in one scan of the text.

    The text is cut at every mapped name, so a replacement is never rewritten again.
    """
    if not names:
        return c
    ordered = sorted(names, key=lambda n: (-len(n), n))
    quoted = "|".join(r"\Q" + n + r"\E" for n in ordered)
    word = rf"(?i)(?<![A-Za-z0-9_])(?:{quoted})(?![A-Za-z0-9_])"
    gaps = F.split(c, word, -1)
    hits = F.regexp_extract_all(c, F.lit(word), F.lit(0))
    table = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k.lower(), v)])
    new = F.transform(hits, lambda h: F.coalesce(F.try_element_at(table, F.lower(h)), h))
    return F.array_join(F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), new.alias("h")), lambda z: F.array(z["g"], F.coalesce(z["h"], F.lit(""))))), "")


def bounded_json_number(c: Column) -> Column:
    """A double as JSON text shows it: whole as an integer, else 6 digits, NaN as null."""
    finite = ~F.isnan(c) & (F.abs(c) != float("inf"))
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(finite & whole, c.cast("bigint").cast("string")).when(
        finite, F.bround(c, 6).cast("string")
    )
