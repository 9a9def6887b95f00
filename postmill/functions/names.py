"""Names that every file system takes: measuring, cleaning, splitting, shortening, numbering."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Character classes and names. Fixed values.
WHITE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
INVISIBLE = r"\x{200B}-\x{200D}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}"
CONTROL = r"\x00-\x08\x0E-\x1F\x7F-\x{84}\x{86}-\x{9F}"
RESERVED = '<>:"|?*'
DEVICE = r"^(CON|PRN|AUX|NUL|CONIN\$|CONOUT\$|(COM|LPT)[0-9\x{B9}\x{B2}\x{B3}])$"
SPECIAL = ("desktop.ini", "thumbs.db", "autorun.inf")
#: ASCII names that nothing has to be done to: legal characters, single spaces within, neither a device nor a special name.
SIMPLE = (
    r"^(?!(?i:CON|PRN|AUX|NUL|CONIN\$|CONOUT\$|(?:COM|LPT)[0-9]) *(?:\.|\z))(?!(?i:desktop\.ini|thumbs\.db|autorun\.inf)\z)(?! )"
    r"(?!.*  )[ !#-)+-.0-9;=@-\[\]-{}]++(?<![. ])\z"
)
FLAGS = (
    "reserved_char_replaced", "control_removed", "invisible_removed", "trimmed", "device_name_mangled", "tilde_replaced", "empty_fallback",
    "truncated", "suffixed", "depth_capped", "special_name_protected",
)
COMPONENT_UNITS = 255


def has(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(pattern))


def upper_ascii(c: Column) -> Column:
    return F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@F.pandas_udf(T.StringType())
def normalized(s: pd.Series) -> pd.Series:
    """NFC, which Spark has no function for."""
    return s.str.normalize("NFC")


def nfc(c: Column) -> Column:
    """NFC; plain ASCII, which most names are, still passes the Arrow batch but comes back unchanged."""
    return normalized(c)


def units(c: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    n = F.char_length(c)
    return F.when(F.octet_length(c) < n + 3, n).otherwise(n + F.char_length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", "")))  # such a character has 3 bytes more


def is_device(stem: Column) -> Column:
    return has(F.rtrim(stem), "(?i)" + DEVICE)


def is_plain(c: Column) -> Column:
    """Whether a text is ASCII, which NFC leaves as it is; null too."""
    return F.coalesce(F.octet_length(c) == F.char_length(c), F.lit(True))


def is_simple(c: Column) -> Column:
    """Whether a text is a name that cleaned() would leave as it is, told by one look; some of those that it would leave aren't."""
    return F.coalesce(has(c, SIMPLE), F.lit(False))


def cleaned(df: DataFrame, column: str, fallback: str, out: str = "safe", plain: bool = False) -> DataFrame:
    """Adds out, struct(name, flags): the column as one legal path component, and the labels of what was done to it. plain: all are ASCII."""
    c = F.col(column)
    bare = F.regexp_replace(c if plain else F.regexp_replace(c, f"[{INVISIBLE}]", ""), f"[{CONTROL}]", "")
    mapped = F.translate(bare, f"~{RESERVED}/\\", "_" * (1 + len(RESERVED)) + "--")
    steps = df.withColumn("_collapsed", F.regexp_replace(mapped if plain else nfc(mapped), f"[{WHITE}]+", " "))
    steps = steps.withColumn("_trimmed", F.rtrim(F.ltrim("_collapsed"), F.lit(". ")))
    t = F.col("_trimmed")
    stem = F.substring_index(t, ".", 1)
    rest = F.substr(t, F.char_length(stem) + 1)
    empty, device = t == "", is_device(stem)
    name = F.when(empty, fallback).when(device, F.concat(F.rtrim(stem), F.lit("_"), rest)).otherwise(t)
    done = (
        has(c, r'[<>:"|?*/\\]'), has(c, f"[{CONTROL}]"), F.lit(False) if plain else has(c, f"[{INVISIBLE}]"), F.col("_collapsed") != t, ~empty & device, has(c, "~"), empty,
    )
    flags = F.filter(F.array(*(F.when(d, label) for d, label in zip(done, FLAGS, strict=False))), lambda x: x.isNotNull())
    return steps.withColumn(out, F.struct(name.alias("name"), flags.alias("flags"))).drop("_collapsed", "_trimmed")


def is_legal(c: Column) -> Column:
    """Whether a name can be written as it is (its normal form aside). Simple names, which most are, are told by one look and their length."""
    stem = F.regexp_extract(c, r"^[^.]*", 0)
    bad = has(c, f'[{CONTROL}{INVISIBLE}<>:"|?*/\\\\~]') | has(c, r"[ .]$|  ") | has(F.translate(c, " ", ""), f"[{WHITE}]")
    return F.when(is_simple(c), units(c) <= COMPONENT_UNITS).otherwise((c != "") & (units(c) <= COMPONENT_UNITS) & ~bad & ~is_device(stem))


def is_special(c: Column) -> Column:
    low = lower_ascii(c)
    return low.isin(*SPECIAL) | F.startswith(low, F.lit("~$"))


def extension(c: Column) -> Column:
    """Extension with its dot: after the last dot, 1 to 16 units without a space, and not all of the name."""
    last = F.substring_index(c, ".", -1)  # all of a name without a dot
    fits = (F.char_length(c) > F.char_length(last) + 1) & (last != "") & ~F.contains(last, F.lit(" ")) & (units(last) <= 16)
    return F.when(fits, F.concat(F.lit("."), last)).otherwise("")


def stem(c: Column) -> Column:
    return F.left(c, F.char_length(c) - F.char_length(extension(c)))


def collision_key(c: Column, plain: bool = False) -> Column:
    """Equal for names that a file system may take for one another. plain: all are ASCII."""
    return F.lower(c) if plain else nfc(F.lower(nfc(c)))


def suffix_width(size: Column) -> Column:
    return F.greatest(F.lit(2), F.char_length(size.cast("string")))


def suffix(number: Column, width: Column) -> Column:
    digits = number.cast("string")
    return F.concat(F.lit(" ("), F.lpad(digits, F.greatest(width, F.char_length(digits)), F.lit("0")), F.lit(")"))


def shorten(text: str, most: int) -> str:
    """At most so many UTF-16 units, ending in an ellipsis where cut; no character loses its combining marks."""
    if sum(1 + (ord(c) > 0xFFFF) for c in text) <= most:
        return text
    used = cut = 0
    while cut < len(text) and used + 1 + (ord(text[cut]) > 0xFFFF) <= most - 1:
        used += 1 + (ord(text[cut]) > 0xFFFF)
        cut += 1
    while 0 < cut < len(text) and unicodedata.combining(text[cut]):
        cut -= 1
    return text[:cut].rstrip(" .") + "…" if most > 0 else ""


@F.pandas_udf(T.StringType())
def shortened(names: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([None if n is None else shorten(n, int(m)) for n, m in zip(names, most, strict=True)], dtype=object)
