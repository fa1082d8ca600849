"""Unicode forms that no built-in function gives, in Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ST


def _plain(text: str | None) -> str | None:
    return text and unicodedata.normalize("NFKC", text)


#: Texts of a batch that are Python strings at a time.
AT_ONCE = 64


def _compatible(text: pa.Array) -> pa.Array:
    parts = (text.slice(i, AT_ONCE).to_pylist() for i in range(0, len(text), AT_ONCE))
    return pa.concat_arrays([pa.array(map(_plain, part), text.type) for part in parts]) if len(text) else text


@F.arrow_udf(ST.StringType())
def compatible(text: pa.Array) -> pa.Array:
    """Compatibility characters as the plain ones (NFKC)."""
    return _compatible(text)


def _spaced(text: str) -> str:
    return "".join(" " if unicodedata.category(c)[0] == "P" else c for c in text)


@F.pandas_udf(ST.ArrayType(ST.StringType()))
def citation_tokens(text: pd.Series) -> pd.Series:
    """Tokens as citations are compared: punctuation as spaces, NFKC, case folded, and punctuation that this brings as spaces again."""
    return text.map(lambda t: _spaced(unicodedata.normalize("NFKC", _spaced(t)).casefold()).split() if t is not None else None)


@F.pandas_udf(ST.StringType())
def course_key(label: pd.Series) -> pd.Series:
    """A label's key: NFKC, spaces collapsed, case folded; empty for none."""
    return label.map(lambda t: " ".join(_plain(t).split()).casefold() if t else "")


def page_text(text: Column) -> Column:
    """A page's text: words that a line's end cut in two whole again, NFKC."""
    return compatible(F.regexp_replace(text, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2"))
