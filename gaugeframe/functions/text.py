"""Text and numeric-token normalisation as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- fixed values -------------------------------------------------------------------------------
TRUE_WORDS = ["1", "true", "t", "yes", "y", "sim", "s", "present", "presente", "both_present", "conforming", "ok"]
FALSE_WORDS = ["0", "false", "f", "no", "n", "nao", "não", "absent", "ausente", "nonconforming"]
UNIT_FACTORS = {
    "k": 1e3, "mil": 1e3,
    "m": 1e6, "milhao": 1e6, "milhoes": 1e6,
    "b": 1e9, "bilhao": 1e9, "bilhoes": 1e9,
}
NUMBER_UNIT = r"(-?\d+(?:[\.,]\d+)?)\s*(milhoes?|milhao|bilhoes?|bilhao|mil|[kmb%])?"
RAW_UNIT = r"\d+(?:[\.,]\d+)?\s*(milhoes?|milhao|bilhoes?|bilhao|mil|[kmb%])\b"
NUMERIC_TOKEN = r"^([-+]?\d+(?:[.,]\d+)?)(MIL|MI|BI|K|M|B)?(%?)$"
SUFFIX_FACTORS = {"": 1.0, "K": 1e3, "MIL": 1e3, "M": 1e6, "MI": 1e6, "B": 1e9, "BI": 1e9}
TOKEN_LETTERS = "OILKMB"
YEAR = r"\b(19\d{2}|20\d{2}|21\d{2})\b"
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻"
SUPERSCRIPTS_PLAIN = "0123456789+-"
DASHES = "–—−"
# ------------------------------------------------------------------------------------------------

HANGUL = (0xAC00, 0xD7A4)


def _base(ch: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))


def _ranges(chars) -> list[tuple[int, int]]:
    """Runs of characters that follow one another, as code points."""
    codes = sorted(map(ord, chars))
    begins = [c for i, c in enumerate(codes) if i == 0 or codes[i - 1] != c - 1]
    ends = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    return list(zip(begins, ends))


def _class_of(ranges: list[tuple[int, int]]) -> str:
    """Inside of a regular-expression class. Its ranges are tried in order on every character of a text."""
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


@lru_cache(maxsize=1)
def _accent_tables() -> tuple[str, str, str, str, str]:
    """Characters whose compatibility decomposition has one base character, with that base; and those
    with several, as a ``str_to_map`` text and as a character class; last the characters that have a digit
    among their base characters.

    Made by rule from every character that has a decomposition; Hangul syllables stay whole.
    """
    one, many = [], []
    for cp in range(0xA0, 0x110000):
        ch = chr(cp)
        if HANGUL[0] <= cp < HANGUL[1] or not unicodedata.decomposition(ch):
            continue
        base = _base(ch)
        if len(base) == 1:
            one.append((ch, base))
        elif len(base) > 1:
            many.append((ch, base))
    pairs = "\x01".join(f"{c}\x02{b}" for c, b in many)
    several = _ranges(c for c, _ in many)
    # ASCII and the letters of Latin 1 are sent away by one range each, before the others are tried
    common = [(0, several[0][0] - 1), (several[0][1] + 1, several[1][0] - 1)]
    digits = "".join(c for c, b in one + many if set(b) & set("0123456789"))
    return "".join(c for c, _ in one), "".join(b for _, b in one), pairs, f"[[^{_class_of(common)}]&&[{_class_of(several)}]]", digits


def let(c: Column, fn) -> Column:
    """``fn(c)`` with ``c`` evaluated once, for expressions that use an intermediate many times."""
    return F.get(F.transform(F.array(c), fn), F.lit(0))


def strip_accents(c: Column) -> Column:
    """Compatibility decomposition without combining marks; plain ASCII texts pass untouched.

    Single characters are translated. Texts with a ligature, fraction, unit or the like are taken apart,
    and each such character is looked up.
    """
    src, dst, pairs, several, _ = _accent_tables()
    known = F.str_to_map(F.lit(pairs), F.lit("\x01"), F.lit("\x02"))
    spelled = F.array_join(F.transform(F.split(c, ""), lambda ch: F.coalesce(F.try_element_at(known, ch), ch)), "")
    whole = F.when(c.rlike(several), spelled).otherwise(c)
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.regexp_replace(F.translate(whole, src, dst), r"\p{M}+", ""))


def _words(values: list[str], c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))), F.lit("")).isin(values)


def truthy(c: Column) -> Column:
    return _words(TRUE_WORDS, c)


def falsey(c: Column) -> Column:
    return _words(FALSE_WORDS, c)


def basename(c: Column) -> Column:
    return F.element_at(F.split(F.trim(c), r"[/\\]"), -1)


def norm_text(c: Column) -> Column:
    return F.lower(strip_accents(c))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def cat_label(c: Column) -> Column:
    """Label normalisation: accents, the one hyphen variant, ``a / b`` and blanks."""
    joined = F.replace(F.trim(norm_text(c)), F.lit("infra-estrutura"), F.lit("infraestrutura"))
    return squeeze(F.regexp_replace(joined, r"\s*/\s*", " e "))


def upper_basic(c: Column) -> Column:
    return squeeze(F.translate(F.upper(strip_accents(c)), DASHES, "---"))


def upper_categorical(c: Column) -> Column:
    return squeeze(F.regexp_replace(upper_basic(c), r"[^A-Z0-9/&+\- ]+", " "))


def upper_label(c: Column) -> Column:
    """The label alphabet used by the slot consensus (keeps ``% . , ( )``)."""
    up = F.translate(F.upper(strip_accents(F.coalesce(c, F.lit("")))), "–—", "--")
    return squeeze(F.regexp_replace(up, r"[^A-Z0-9/%+\-.,() ]+", " "))


def upper_numeric(c: Column) -> Column:
    no_money = F.replace(F.replace(upper_basic(c), F.lit("R$"), F.lit("")), F.lit("$"), F.lit(""))
    return F.regexp_replace(no_money, r"\s+", "")


def letters_in(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^A-Z]", ""))


def char_share(c: Column, kept: str) -> Column:
    """Share of ``kept`` (a character class body) among A-Z0-9 of the normalised label."""

    def share(chars: Column) -> Column:
        part = F.length(F.regexp_replace(chars, f"[^{kept}]", ""))
        return F.when(F.length(chars) == 0, F.lit(0.0)).otherwise(part / F.length(chars))

    return let(F.regexp_replace(upper_label(c), r"[^A-Z0-9]", ""), share)


def alpha_ratio(c: Column) -> Column:
    return char_share(c, "A-Z")


def numeric_ratio(c: Column) -> Column:
    return char_share(c, "0-9")


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def unit_multiplier(unit: Column) -> Column:
    """Multiplier of a unit word; NULL marks a percentage."""
    u = F.trim(norm_text(F.coalesce(unit, F.lit(""))))
    return F.when(u == "%", F.lit(None).cast("double")).otherwise(
        F.coalesce(F.element_at(literal_map(UNIT_FACTORS), u), F.lit(1.0))
    )


def years(c: Column) -> Column:
    """Years in a text. A blank ends a year on either side, so only words that hold a digit, or a
    character that becomes one, are normalised."""
    digits = _ranges("0123456789" + _accent_tables()[4])
    ends = sorted([*digits, (9, 13), (32, 32)])
    others = [(a + 1, b - 1) for (_, a), (b, _) in zip([(0, -1), *ends], [*ends, (0x110000, 0)]) if a + 1 < b]
    others.sort(key=lambda r: not r[0] <= ord("a") <= r[1])  # the most common first
    words = F.regexp_extract_all(c, F.lit(rf"(?<!\S)[{_class_of(others)}]*+[{_class_of(digits)}]\S*+"), F.lit(0))
    return F.regexp_extract_all(let(F.array_join(words, " "), upper_basic), F.lit(YEAR), F.lit(1))


def _token_parts(up: Column, fixed: Column, foreign: Column) -> Column:
    number, suffix = F.regexp_extract(fixed, NUMERIC_TOKEN, 1), F.regexp_extract(fixed, NUMERIC_TOKEN, 2)
    # the pattern admits a single separator: a comma is decimal with at most two digits after it
    point = F.when(number.rlike(r",\d{1,2}$"), ".").otherwise("")
    value = F.replace(number, F.lit(","), point).try_cast("double")
    factor = F.element_at(literal_map(SUFFIX_FACTORS), suffix)
    return F.when(
        (~foreign) & fixed.rlike(NUMERIC_TOKEN),
        F.struct(
            fixed.alias("text"),
            value.alias("value"),
            suffix.alias("suffix"),
            factor.alias("factor"),
            (value * factor).alias("full"),
            up.contains("$").cast("int").alias("currency"),
            up.contains("%").cast("int").alias("percent"),
        ),
    )


def numeric_token(c: Column) -> Column:
    """Strict numeric token as ``STRUCT<text,value,suffix,factor,full,currency,percent>`` or NULL."""

    def from_upper(up: Column) -> Column:
        money = F.replace(F.replace(up, F.lit("R$"), F.lit("")), F.lit("$"), F.lit(""))
        trimmed = F.regexp_replace(money, r"^[()\[\]{}:;]+|[()\[\]{}:;]+$", "")
        return let(F.regexp_replace(trimmed, r"\s+", ""), lambda bare: from_bare(up, bare))

    def from_bare(up: Column, bare: Column) -> Column:
        foreign = bare.rlike(f"[A-Z&&[^{TOKEN_LETTERS}]]")
        fixed = F.when(bare.rlike(r"\d"), F.translate(bare, "OIL", "011")).otherwise(bare)
        return let(fixed, lambda x: _token_parts(up, x, foreign))

    return let(upper_basic(c), from_upper)


def _ocr_digits(c: Column) -> Column:
    return F.translate(c, "OB", "08")


def scale_text(c: Column) -> Column:
    """Scientific-notation text after the position-bound reading fixes."""
    s = F.translate(F.upper(strip_accents(F.translate(c, SUPERSCRIPTS, SUPERSCRIPTS_PLAIN))), "×*−–—", "XX---")
    s = F.regexp_replace(F.regexp_replace(s, r"\s+", ""), r"^[IL](?=E)", "1")

    def fix(form: str):
        return lambda x: F.when(
            x.rlike(form), F.concat(F.regexp_extract(x, form, 1), _ocr_digits(F.regexp_extract(x, form, 2)))
        ).otherwise(x)

    return let(let(s, fix(r"^(1E[+-]?)([0-9OB]{1,3})$")), fix(r"^(X?10\^?[+-]?)([0-9OB]{1,3})$"))


def scale_exponent(c: Column) -> Column:
    """Exponent of a whole-string scientific form, else NULL."""
    form = r"^(?:1E|X10\^?|10\^)([+-]?\d{1,3})$"
    return F.regexp_extract(scale_text(c), form, 1).try_cast("int")


def token_usable(c: Column, kind: Column) -> Column:
    ok = (
        F.when(kind == "categorical", letters_in(upper_categorical(c)) >= 2)
        .when(kind == "temporal", F.size(years(c)) > 0)
        .when(kind == "numeric", numeric_token(c).isNotNull())
        .otherwise(F.lit(True))
    )
    return F.when(F.length(F.trim(F.coalesce(c, F.lit("")))) == 0, F.lit(False)).otherwise(ok)


def semantic_score(c: Column, conf: Column, kind: Column) -> Column:
    label = let(
        upper_categorical(c),
        lambda x: F.when(letters_in(x) >= 3, 25.0).otherwise(0.0) + F.when(F.length(x) >= 5, 10.0).otherwise(0.0),
    )
    dates = let(F.size(years(c)), lambda n: F.when(n > 0, 45.0 + 4.0 * n).otherwise(0.0))
    bonus = (
        F.when(kind == "categorical", label)
        .when(kind == "temporal", dates)
        .when(kind == "numeric", F.when(numeric_token(c).isNotNull(), 35.0).otherwise(0.0))
        .otherwise(0.0)
    )
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.lit(-999.0)).otherwise(F.greatest(F.lit(-1.0), conf) + bonus)


def suspicious_text(c: Column) -> Column:
    """Reason a selected label looks cut at an edge; blank when it does not."""
    raw = F.trim(c)
    raw_letters = F.length(F.regexp_replace(raw, r"[^A-Za-z]", ""))

    def reason(label: Column) -> Column:
        words = F.filter(F.split(label, " "), lambda w: w.rlike("[A-Z]"))
        cut = let(words, lambda ws: (F.size(ws) >= 2) & (F.length(F.get(ws, F.size(ws) - 1)) == 1))
        return (
            F.when(F.length(label) == 0, "")
            .when(raw.rlike(r"^[-_/.,;:]") & (raw_letters >= 6), "LEADING_EDGE_PUNCTUATION")
            .when(cut & (letters_in(label) >= 8), "TRAILING_SINGLE_LETTER")
            .otherwise("")
        )

    return let(upper_label(c), reason)


@F.pandas_udf(StringType())
def _six_digits(v: pd.Series) -> pd.Series:
    return v.map("{:g}".format, na_action="ignore").astype(object).where(v.notna(), None)


def general_number(v: Column) -> Column:
    """Whole numbers without decimals, anything else with six significant digits.

    The JVM formats doubles from their shortest decimal text, which rounds exact ties differently
    from the binary value, hence the one vectorised Python helper.
    """
    whole = F.rint(v).cast("bigint").cast("string")
    return F.when(F.abs(v - F.rint(v)) < 1e-9, whole).otherwise(_six_digits(v))


@F.arrow_udf(StringType())
def _typed_numbers(typ: pa.Array, value: pa.Array) -> pa.Array:
    """Each distinct number is spelled once a batch; an item without a value is left out."""

    def shown(percent: bool, v: float) -> str:
        if not percent and abs(v - np.rint(v)) < 1e-9:
            return str(round(v))
        return f"{v:g}" + "%" * percent

    flat = value.flatten()
    there = flat.is_valid().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(value)), value.value_lengths().fill_null(0).to_numpy())[there]
    numbers = flat.drop_null().to_numpy().astype(float)
    percent = pc.equal(typ.flatten(), "PCT").fill_null(False).to_numpy(zero_copy_only=False)[there]
    bits, number = np.unique(numbers.view(np.int64), return_inverse=True)  # by bits: -0 is not 0
    codes, item = np.unique(number * 2 + percent, return_inverse=True)
    texts = pa.array([shown(c % 2 == 1, v) for c, v in zip(codes.tolist(), bits[codes // 2].view(float).tolist())], pa.string())
    ends = np.searchsorted(owner, np.arange(len(value) + 1))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), texts.take(pa.array(item))), " | ")
    return pc.if_else(value.is_valid(), joined, pa.scalar(None, pa.string()))


def typed_numbers(items: Column) -> Column:
    """A list of ``STRUCT<typ,value>`` as text: whole numbers without decimals, others and percentages with six digits."""
    return _typed_numbers(F.transform(items, lambda i: i["typ"]), F.transform(items, lambda i: i["value"]))


def pad_condition(c: Column) -> Column:
    """Condition code with a trailing ``.0`` dropped and padded to two digits."""
    code = F.regexp_replace(c.cast("string"), r"\.0$", "")
    return F.when(F.length(code) < 2, F.lpad(code, 2, "0")).otherwise(code)
