"""Simple questions answered as one aggregate over a table."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, functions as F, types as T

from tablesight.functions.nulls import col, try_double
from tablesight.operators.profile import profiled_columns

# Words that ask for an aggregate, in order of precedence.
VERBS = (
    ("sum", ("sum", "total", "add")),
    ("mean", ("average", "mean", "avg")),
    ("count", ("count", "number of", "how many")),
    ("max", ("max", "maximum", "highest", "largest")),
    ("min", ("min", "minimum", "lowest", "smallest")),
)
# Words that say nothing about a column.
STOP_WORDS = ("the", "is", "of", "for", "in", "what", "give", "me", "get", "show", "find", "calculate", "data")


@dataclass(frozen=True)
class Question:
    """What a question asks for, once resolved against a table."""

    function: str
    column: str
    filter_column: str | None = None
    filter_value: Any = None


def verb(question: str) -> str | None:
    """The aggregate a question asks for; only whole words count."""
    text = question.lower()
    for function, triggers in VERBS:
        if any(re.search(rf"\b{re.escape(t)}\b", text) for t in triggers):
            return function
    return None


def _root(word: str) -> str:
    """A word without plural or participle endings, at least three letters long."""
    return re.sub(r"(?<=[a-z]{3})(?:ings?|ed|es|s)$", "", word)


def column_match(column: str, question: str) -> tuple[int, int]:
    """The best kind of match of a column name with a question, and how many of its words take part.

    4: the whole name is a phrase of the question; 3: all its words occur; 2: some word occurs; 1: some word shares its
    root, or abbreviates a word or the other way round; 0: none.
    """
    spoken = re.findall(r"[a-z0-9]+", question.lower())
    asked = set(spoken) - set(STOP_WORDS)
    own = re.findall(r"[a-z0-9]+", column.lower().replace("_", " "))
    named = [w for w in own if len(w) > 1]
    if f" {' '.join(own)} " in f" {' '.join(spoken)} ".replace("_", " ") or column.lower() in question.lower().split():
        return 4, len(named)
    exact = [w for w in named if w in asked]
    if exact:
        return (3 if len(exact) == len(named) else 2), len(exact)
    near = [w for w in named if len(w) > 2 and any(
        _root(w) == _root(a) or (min(len(a), len(w)) > 2 and (a.startswith(w) or w.startswith(a) or w.endswith(a))) for a in asked)]
    return (1, len(near)) if near else (0, 0)


def best_column(df: DataFrame, question: str) -> str | None:
    """The numeric column whose name matches best; the first in the schema on ties or when none matches."""
    numbers = [c for c in profiled_columns(df) if isinstance(df.schema[c].dataType, T.NumericType)]
    return max(numbers, key=lambda c: column_match(c, question), default=None)


def find_filter(df: DataFrame, question: str) -> tuple[str | None, Any]:
    """First column named in the question of which a value occurs in it too; the longest value wins.

    One aggregate looks at all named columns; it keeps a single value per column and task.
    """
    text = question.lower()
    named = [c for c in profiled_columns(df) if c.lower() in text or c.lower().replace("_", " ") in text]
    if not named:
        return None, None
    picks = []
    for i, c in enumerate(named):
        shown = F.lower(col(c).cast("string"))
        size = F.length(shown)
        mentioned = (size > 0) & F.contains(F.lit(text), shown)
        # Longest first, then alphabetical.
        rank = F.when(mentioned, F.struct((-size).alias("l"), shown.alias("s"), col(c).alias("v")))
        picks.append(F.min(rank).alias(f"p{i}"))
    found = df.agg(*picks).first()
    for i, c in enumerate(named):
        if found[f"p{i}"] is not None:
            return c, found[f"p{i}"]["v"]
    return None, None


def resolve(df: DataFrame, question: str) -> Question | None:
    """Function, column and filter of a question, or None when it asks for no aggregate."""
    function = verb(question)
    column = best_column(df, question) if function else None
    if column is None:
        return None
    name, value = find_filter(df, question)
    return Question(function, column, name, value)


def answer(df: DataFrame, question: str, source: str = "table") -> DataFrame | None:
    """One row ``(function, column, filter_column, filter_value, value, rows, answer)``, or None."""
    q = resolve(df, question)
    if q is None:
        return None
    rows = df if q.filter_column is None else df.where(col(q.filter_column) == F.lit(q.filter_value))
    measure = col(q.column)
    value = {
        "sum": F.coalesce(F.sum(measure), F.lit(0)), "mean": F.avg(measure), "count": F.count(F.lit(1)),
        "max": F.max(measure), "min": F.min(measure),
    }[q.function].cast("double")
    where = "for all data" if q.filter_column is None else f"for {q.filter_column}={q.filter_value}"
    tail = "" if q.filter_column is None else f" where {q.filter_column} = '{q.filter_value}'"
    out = rows.agg(value.alias("value"), F.count(F.lit(1)).alias("rows"))
    sentence = F.concat(
        F.lit(f"Based on the data in {source}:\n\nThe {q.function} of '{q.column}' {where} is: **"),
        F.format_number("value", 2), F.lit("**\n\n(Calculated from "), F.col("rows").cast("string"),
        F.lit(f" rows{tail})"))
    shown = None if q.filter_value is None else str(q.filter_value)
    return out.select(
        F.lit(q.function).alias("function"), F.lit(q.column).alias("column"),
        F.lit(q.filter_column).cast("string").alias("filter_column"), F.lit(shown).cast("string").alias("filter_value"),
        "value", "rows", sentence.alias("answer"))


def sum_shortcut(df: DataFrame, question: str) -> DataFrame | None:
    """One row ``(column, value, answer)`` for "sum of <column>" questions.

    The column is the longest name that the question contains; its values may be numbers written as text.
    """
    text = question.lower()
    if not ("sum of" in text or "total of" in text or text.startswith("sum ")):
        return None
    spoken = {c: (c.lower(), c.lower().replace("_", " ")) for c in df.columns}
    named = [c for c, forms in spoken.items() if any(re.search(rf"\b{re.escape(f)}\b", text) for f in forms)]
    if not named:
        return None
    column = max(named, key=len)
    total = F.coalesce(F.sum(try_double(col(column))), F.lit(0.0))
    return df.agg(total.alias("value")).select(
        F.lit(column).alias("column"), "value",
        F.concat(F.lit(f"Sum of {column} is "), F.col("value").cast("string")).alias("answer"))
