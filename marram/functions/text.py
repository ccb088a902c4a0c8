"""Text functions: Unicode-aware keys, delimited lists, search scores."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ALIAS_SEPARATOR = "|"


def fold(text: str) -> str:
    """NFKC, case-folded, surrounding white space removed."""
    return unicodedata.normalize("NFKC", text).casefold().strip()


def _all_folded(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else fold(t) for t in texts.to_pylist()], pa.string())


def _fold_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from map(_all_folded, batches)


def _fold_lists(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for lists in batches:
        yield pa.array([None if texts is None else [None if t is None else fold(t) for t in texts] for texts in lists.to_pylist()], pa.list_(pa.string()))


def is_plain(text: Column) -> Column:
    """ASCII only; null is plain."""
    return F.coalesce(text.rlike("^[\\x00-\\x7f]*$"), F.lit(True))


def folded_plain(text: Column) -> Column:
    """``fold`` of an ASCII column, in the JVM."""
    return F.trim(F.lower(F.regexp_replace(text, "^\\s+|\\s+$", "")))


def folded_any(text: Column) -> Column:
    """``fold`` of a column, through Arrow: for rows that are known not to be plain."""
    return F.arrow_udf(_fold_texts, "string")(text)


def folded_lists(texts: Column) -> Column:
    """``fold`` of every text of an array column, through Arrow."""
    return F.arrow_udf(_fold_lists, "array<string>")(texts)


def folded(text: Column) -> Column:
    """``fold`` of a column of any text. ASCII is folded in the JVM, but Spark hands every row to Python, plain ones as nulls: fold tables
    that are read often once (``registry.prepared``).
    """
    plain = is_plain(text)
    return F.when(plain, folded_plain(text)).otherwise(folded_any(F.when(~plain, text)))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def compact(text: Column) -> Column:
    """Only digits, a-z and CJK ideographs of a folded text."""
    return F.regexp_replace(text, "[^0-9a-z\\u3400-\\u9fff]+", "")


def aliases(text: Column) -> Column:
    """Trimmed, non-blank parts of a delimited list; null has none."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[|]"), lambda a: F.trim(a)), lambda a: a != "")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, "[\\s,，、/]+"), lambda t: t != "")


def search_score(query: str, identifier: Column, label: Column, words: Column, terms: Column) -> Column:
    """Relevance of a folded entry to a query: whole phrase 30, label or identifier inside the query 20, each token 5, each of
    its terms inside the query 8; phrases are compared in compact form. A blank query scores 1.
    """
    q = fold(query)
    short = re.sub("[^0-9a-z\u3400-\u9fff]+", "", q)
    if not short:
        return F.lit(1)
    text = F.concat_ws(" ", identifier, label, words)
    inside = lambda c: (compact(c) != "") & F.contains(F.lit(short), compact(c))
    hit = lambda c, n: F.when(c, n).otherwise(0)
    score = hit(F.contains(compact(text), F.lit(short)), 30) + hit(inside(label), 20) + hit(inside(identifier), 20)
    for p in [p for p in re.split("[\\s,，、/]+", q) if p]:
        score = score + hit(F.contains(text, F.lit(p)), 5)
    return score + 8 * F.size(F.filter(terms, inside))
