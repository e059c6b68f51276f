"""Names, keys and ids as column expressions. Python only for what is not ASCII."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as the original data's tools see it: Unicode's, and the byte order mark.
SPACE = "[\\u0009-\\u000D\\u0020\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
UNIT = "\x1f"


def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(x: Column) -> Column:
    """NFC; ASCII values never leave the JVM (they go to Python as nulls)."""
    to_nfc = F.pandas_udf(_nfc, "string")
    return F.coalesce(to_nfc(F.when(~x.rlike("^[\\x00-\\x7F]*$"), x)), x)


def composed(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the column in NFC; only rows with other than ASCII values go through Python, and no worker starts where Spark knows that there are none."""
    plain = F.coalesce(F.col(column).rlike("^[\\x00-\\x7F]*$"), F.lit(True))
    return df.where(plain).unionByName(df.where(~plain).withColumn(column, nfc(F.col(column))))


def trim_space(x: Column) -> Column:
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def name_key(x: Column) -> Column:
    """NFC, trimmed, runs of white space to one space, lower case. Never NFKC."""
    return F.lower(F.regexp_replace(trim_space(nfc(x)), f"{SPACE}+", " "))


def ascii_name_key(x: Column) -> Column:
    """The same without the NFC step, for columns that are known to be composed."""
    return F.lower(F.regexp_replace(trim_space(x), f"{SPACE}+", " "))


def sha16(x: Column) -> Column:
    return F.substring(F.sha2(x, 256), 1, 16)


def node_kgid(label: Column, key: Column) -> Column:
    return F.concat(F.lit("n_"), sha16(F.concat(label, F.lit(UNIT), key)))


def rel_kgid(start: Column, type_: Column, end: Column) -> Column:
    return F.concat(F.lit("r_"), sha16(F.concat(start, F.lit(UNIT), type_, F.lit(UNIT), end)))


def document_key(content: Column) -> Column:
    """Key of a document's bytes: they are read as Latin-1 and hashed as UTF-8."""
    return sha16(F.encode(F.decode(content, "ISO-8859-1"), "UTF-8"))


def _char(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def jamo(x: Column) -> Column:
    """Hangul syllables as two or three private-use characters each (one per jamo); others as they are."""
    parts = F.transform(
        F.split(x, ""),
        lambda c: F.when(
            (F.ascii(c) >= 0xAC00) & (F.ascii(c) <= 0xD7A3),
            F.concat(
                _char(F.lit(0xE000) + F.floor((F.ascii(c) - 0xAC00) / 588).cast("int")),
                _char(F.lit(0xE100) + F.floor(F.pmod(F.ascii(c) - 0xAC00, F.lit(588)) / 28).cast("int")),
                F.when(F.pmod(F.ascii(c) - 0xAC00, F.lit(28)) > 0, _char(F.lit(0xE200) + F.pmod(F.ascii(c) - 0xAC00, F.lit(28)))).otherwise(F.lit("")),
            ),
        ).otherwise(c),
    )
    return F.array_join(parts, "")


def jamo_distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance over jamo; ``most + 1`` where it is larger."""
    d = F.levenshtein(jamo(a), jamo(b), most)
    return F.when(d < 0, F.lit(most + 1)).otherwise(d)


def property_value(json_text: Column) -> Column:
    """A property's JSON text with a string value in NFC and trimmed; equal texts are equal values."""
    quoted = json_text.rlike('^".*"$')
    inner = trim_space(nfc(F.from_json(F.concat(F.lit('{"v":'), json_text, F.lit("}")), "v string")["v"]))
    return F.when(quoted, F.concat(F.lit('"'), inner, F.lit('"'))).otherwise(json_text)


def escape_query(x: Column) -> Column:
    """Full-text operators with a backslash in front."""
    return F.regexp_replace(x, r'([+\-&|!(){}\[\]^"~*?:\\/])', r"\\$1")
