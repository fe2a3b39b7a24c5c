"""Intents of questions, as column expressions: one question or a table of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The intents' patterns in order; the first that matches wins, and all but the first and the last need a name.
INTENTS = (
    ("deadcode", r"(dead\s*code|unused\s+(function|method|code)|unused)"),
    ("callers", r"(who|what)\s+(calls?|uses?|invokes?)|callers?\s+of"),
    ("callees", r"(what)\s+(does).*call|callees?\s+of|depends?\s+on"),
    ("importers", r"(who)\s+(imports?|uses?\s+module)|importers?\s+of"),
    ("hierarchy", r"(class\s+hierarch|inheritance|extends?|implements?|parent\s+class|child\s+class|subclass|superclass)"),
    ("impact", r"(impact|blast\s*radius|what\s+breaks?|affected|what\s+happens?\s+if\s+(i\s+)?(change|modify|refactor))"),
    ("git_changes", r"(what\s+changed|recent\s+changes?|git\s+(changes?|log|history)|changed\s+(this|last|in)\s+)"),
)
# Words that are no symbol names.
STOP_WORDS = ("who", "what", "calls", "callers", "callees", "uses", "of", "the", "function", "class", "method", "module", "does", "is", "are")
# Words of backend and frontend questions.
BACKEND = r"(\bbackend\b|\bendpoint\b|\bcontroller\b|\bdatabase\b|\bmigration\b|\bmiddleware\b|\bORM\b|\bSQL\b|\brepository\b|\bdaemon\b)"
FRONTEND = r"(frontend|component|\.tsx|\.jsx|\bui\b|button|modal|dialog|layout|widget|stylesheet|css|tailwind)"
QUOTED = r"""["']([\p{L}\p{N}_]+)["']"""
#: Between characters that are no letters, digits or ``_`` of any script.
IDENTIFIER = r"(?:^|[^\p{L}\p{N}_])([A-Z][a-zA-Z0-9]+|[a-z]+_[a-z_]+)(?:[^\p{L}\p{N}_]|$)"


def symbol_name(query: Column) -> Column:
    """A quoted word, else the first CamelCase or snake_case one, else the last that isn't a stop word; null if none."""
    words = F.transform(F.split(query, r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_]", ""))
    usable = F.filter(words, lambda w: (w != "") & ~F.lower(w).isin(*STOP_WORDS))
    found = lambda pattern: F.nullif(F.regexp_extract(query, pattern, 1), F.lit(""))
    return F.coalesce(found(QUOTED), found(IDENTIFIER), F.when(F.size(usable) > 0, F.element_at(usable, -1)))


def intent(query: Column) -> Column:
    name = symbol_name(query)

    def rule(rest: Column, item: tuple[str, str]) -> Column:
        matched = query.rlike("(?i)" + item[1])
        return F.when(matched if item[0] in ("deadcode", "git_changes") else matched & name.isNotNull(), F.lit(item[0])).otherwise(rest)

    return reduce(rule, reversed(INTENTS), F.lit("search"))


def since(query: Column) -> Column:
    """The time span that a question about changes names."""
    number, unit = F.regexp_extract(query, r"(?i)(\d+)\s*(day|week|month)", 1), F.lower(F.regexp_extract(query, r"(?i)(\d+)\s*(day|week|month)", 2))
    return F.when(number != "", F.concat(number, F.lit(" "), unit, F.lit("s ago"))).otherwise("1 week ago")


def project_type(query: Column) -> Column:
    """backend or frontend; null if the question is about both or neither."""
    back, front = query.rlike("(?i)" + BACKEND), query.rlike("(?i)" + FRONTEND)
    return F.when(back & ~front, "backend").when(front & ~back, "frontend")


def routed(questions: DataFrame, column: str = "query") -> DataFrame:
    q = F.col(column)
    return questions.withColumn("intent", intent(q)).withColumn("symbol", symbol_name(q)).withColumn("since", F.when(F.col("intent") == "git_changes", since(q)))


def path_in_question(query: Column) -> Column:
    """``in some/path`` of a question, or null: an opt-in path filter."""
    return F.nullif(F.regexp_extract(query, r"(?i)\bin\s+([\w.-]+(?:/[\w.-]+)+/?)", 1), F.lit(""))
