"""Labels for questions and requests, as column expressions over tables of them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tablesight.functions.text import contains_any

# Signal words of a question.
QUALITATIVE = ("summarize", "explain", "what does", "describe", "key points", "overview", "gist", "interpret")
QUANTITATIVE = (
    "how many", "count", "average", "mean", "sum", "total", "trend", "top ", "bottom ", "compare",
    "distribution", "variance", "median", "chart", "graph", "plot", "visualize",
)
# Words asking for a written report and for charts.
REPORT_WORDS = ("report", "pdf", "executive", "insights")
CHART_WORDS = ("chart", "plot", "visual", "dashboard", "graph")
# Words that send a plain question to the charts.
ROUTE_CHART_WORDS = ("chart", "plot", "visual")


def intent(question: Column) -> Column:
    """qualitative or quantitative; quantitative when in doubt."""
    text = F.lower(F.trim(F.coalesce(question, F.lit(""))))
    return F.when(contains_any(text, QUALITATIVE) & ~contains_any(text, QUANTITATIVE), "qualitative").otherwise(
        "quantitative")


def output_mode(question: Column, has_structured: Column, preference: Column | None = None) -> Column:
    """report or plotly: an explicit preference, else the words used, else the kind of data."""
    text = F.lower(F.coalesce(question, F.lit("")))
    report = contains_any(text, REPORT_WORDS)
    chart = contains_any(text, CHART_WORDS) | has_structured
    guessed = (
        F.when(report & ~chart, "report").when(chart & ~report, "plotly")
        .when(has_structured, "plotly").otherwise("report"))
    if preference is None:
        return guessed
    wanted = F.lower(F.trim(preference))
    return F.when(wanted.isin("report", "plotly"), wanted).otherwise(guessed)


def export_mode(secondary: Column) -> Column:
    """report_only, plotly_only or both."""
    wanted = F.lower(F.trim(F.coalesce(secondary, F.lit(""))))
    return F.when(wanted == "report", "report_only").when(wanted == "chart", "plotly_only").otherwise("both")


def route(question: Column, primary: Column, secondary: Column, has_files: Column, has_index: Column) -> Column:
    """Steps of a request as an array, ending with monitoring when there is any step.

    ``has_index`` says whether text search is available for the request.
    """
    text = F.lower(F.coalesce(question, F.lit("")))
    kind = F.lower(F.trim(F.coalesce(secondary, F.lit("None"))))
    wants_output = kind.isin("report", "chart")
    wants_chart = contains_any(text, ROUTE_CHART_WORDS) | ~has_index
    steps = lambda *names: F.array(*[F.lit(n) for n in names])
    chosen = (
        F.when(F.lower(primary) == "qualitative", steps("retrieval"))
        .when(has_files & (wants_output | wants_chart), steps("processing", "charts"))
        .when(has_files, steps("processing", "retrieval"))
        .when(wants_output, steps("charts"))
        .otherwise(steps("retrieval")))
    return F.concat(chosen, steps("monitoring"))
