"""Token and text clean-up as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# every character that counts as white space in Unicode text
WHITESPACE = (
    r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
NUMBER = r"[-+]?\d*\.?\d+"
NUMERIC_LIKE = r"^[\p{Nd}\.,:%$OoIlSB\-+]+$"
# characters that recognisers confuse with digits
DIGIT_LOOKALIKES = ("OoIlSB", "001158")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def normalize_whitespace(text: Column) -> Column:
    # collapsed first, the ends are plain spaces and need no second regex
    return F.trim(F.regexp_replace(text, f"{WHITESPACE}+", " "))


def correct_numeric_token(token: Column) -> Column:
    """Map look-alike letters to digits, only in tokens that are numeric-like throughout."""
    cleaned = strip(token)
    return F.when(cleaned.rlike(NUMERIC_LIKE), F.translate(cleaned, *DIGIT_LOOKALIKES)).otherwise(cleaned)


def clean_one(text: Column) -> Column:
    """Collapse white space, then drop everything outside printable ASCII."""
    return F.regexp_replace(normalize_whitespace(text), r"[^\x20-\x7E]", "")


def clean_text_list(texts: Column) -> Column:
    """Cleaned, non-empty texts; of texts equal but for case only the first stays."""
    # most texts are words that need no cleaning; lists are sorted by sort_array, as array_sort compares by an expression
    cleaned = F.transform(texts, lambda t: F.when(t.rlike(r"[^\x21-\x7E]"), clean_one(t)).otherwise(t))
    entries = F.transform(cleaned, lambda t, i: F.struct(F.lower(t).alias("key"), i.alias("i"), t.alias("text")))
    ordered = F.sort_array(F.filter(entries, lambda e: e["key"] != ""))
    # wrapping the sorted list in an array binds it once instead of once per element
    first = F.transform(
        F.array(ordered),
        lambda lst: F.filter(lst, lambda e, j: (j == 0) | (e["key"] != F.get(lst, j - 1)["key"])),
    )[0]
    by_place = F.sort_array(F.transform(first, lambda e: F.struct(e["i"].alias("i"), e["text"].alias("text"))))
    return F.transform(by_place, lambda e: e["text"])


def extract_numbers(text: Column) -> Column:
    """All numbers in the text, as doubles."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), 1), lambda t: t.cast("double"))


def ellipsize(text: Column, limit: int) -> Column:
    """Collapse white space and cut to ``limit`` characters, the last three being '...'."""
    flat = normalize_whitespace(F.coalesce(text, F.lit("")))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 3), F.lit("..."))).otherwise(flat)


def has_digit(text: Column) -> Column:
    return text.rlike(r"\d")


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def is_plain_number(text: Column) -> Column:
    """Digits only once thousands commas, percent signs and the first dot are removed."""
    bare = F.regexp_replace(strip(text), "[,%]", "")
    dot = F.instr(bare, ".")
    undotted = F.when(dot > 0, F.concat(F.substring(bare, F.lit(1), dot - 1), F.substring(bare, dot + 1, F.length(bare))))
    return F.coalesce(undotted, bare).rlike(r"^\d+$")


def safe_double(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(value.cast("string").try_cast("double"), F.lit(default))


def clip(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
