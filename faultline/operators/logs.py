"""Log analytics over tables of task logs.

The reference parses one log string in Python. Here a log table is processed
as Spark jobs: lines are exploded rows, the keyword context is a bounded
fan-out joined back on (log, line), and the per-log line count is a partial
aggregation, so one huge log is spread over many tasks instead of one window
partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import contains_any, empty_to_null, split_lines
from faultline.plans import rules

# --- fixed values: error signatures, in declaration order --------------------------
# (name, pattern, error_type, sql_state)
SIGNATURES = [
    ("not_null_violation", r'null value in column "(\w+)".*not-null constraint', "not_null_violation", "23502"),
    ("type_cast_failure", r'invalid input syntax for type (\w+): "([^"]+)"', "type_cast_failure", "22P02"),
    ("relation_not_found", r'relation "([^"]+)" does not exist', "relation_not_found", "42P01"),
    ("column_not_found", r'column "(\w+)" (?:of relation "(\w+)" )?does not exist', "column_not_found", "42703"),
    ("permission_denied", r"permission denied for (\w+) (\w+)", "permission_denied", "42501"),
    ("unique_violation", r"duplicate key value violates unique constraint", "unique_violation", "23505"),
    ("dbt_compile_error", r"Compilation Error in model (\w+)", "dbt_compile_error", None),
    ("dbt_database_error", r"Database Error in model (\w+)", "dbt_database_error", None),
    ("invalid_date", r'invalid input syntax for type date: "([^"]+)"', "type_cast_failure", "22007"),
]
TABLE_REFERENCE = r'(?:relation|table|from|join|into)\s+"?(\w+)"?\."?(\w+)"?'
COLUMN_REFERENCE = r'column "(\w+)"'
MODEL_REFERENCE = r"model (\w+)"
# --- end of fixed values ---------------------------------------------------------------

# Java flags giving Python `re` semantics: case-insensitive, Unicode \w and
# case folding, and only '\n' ends a line for '.'.
_FLAGS = "(?iUd)"


def _group_count(pattern: str) -> int:
    import re
    return re.compile(pattern).groups


# --- L0 / L3 ----------------------------------------------------------------------------


def split_log_lines(df: DataFrame, keys: list[str], text: str, with_total: bool = False) -> DataFrame:
    """L0: (keys, line_no, line), 0-based, splitlines() semantics; with
    ``n_lines``, the log's number of lines, if asked for."""
    lines = df.select(*keys, split_lines(F.col(text)).alias("_lines"))
    total = [F.size("_lines").alias("n_lines")] if with_total else []
    return lines.select(*keys, *total, F.posexplode("_lines").alias("line_no", "line"))


def is_keyword_line(line: Column) -> Column:
    return contains_any(line, rules.LOG_KEYWORDS)


def error_lines(lines: DataFrame) -> DataFrame:
    """L3: lines holding a keyword (case-sensitive), whitespace-stripped."""
    return lines.where(is_keyword_line(F.col("line"))) \
        .withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))


# --- L1 / L2 ----------------------------------------------------------------------------


def relevant_lines(lines: DataFrame, keys: list[str], tail: int = rules.LOG_TAIL_LINES,
                   context: int = rules.LOG_CONTEXT_LINES) -> DataFrame:
    """L1: a log of at most ``tail`` lines is kept whole; a longer one keeps
    its last ``tail`` lines plus ``context`` lines around every keyword line
    (overlaps merge, since kept lines form a set).

    The log's length is the column ``n_lines`` where the split gives it, else
    it is counted and joined on the log. The context window is a fan-out of
    2*context+1 line numbers per keyword line, joined back on (log, line).
    """
    if "n_lines" in lines.columns:
        counted = lines.withColumnRenamed("n_lines", "_total")
    else:
        counted = lines.join(lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total")), keys, "inner")
    near = lines.where(is_keyword_line(F.col("line"))).select(
        *keys, F.explode(F.sequence(F.greatest(F.col("line_no") - context, F.lit(0)),
                                    F.col("line_no") + context)).alias("line_no")) \
        .distinct().withColumn("_near", F.lit(True))
    j = counted.join(near, keys + ["line_no"], "left")
    keep = (F.col("_total") <= tail) | (F.col("line_no") >= F.col("_total") - tail) | F.col("_near").isNotNull()
    return j.where(keep).select(*keys, "line_no", "line")


def omitted_marker(n: Column) -> Column:
    return F.format_string("... (%d lines omitted) ...", n)


def truncate_log(kept: DataFrame, keys: list[str]) -> DataFrame:
    """L2: kept lines re-assembled in order with a gap marker before every run
    of omitted lines. Deviation: the reference also emits a marker before
    line 0 and counts the first gap one too high; we mark only real gaps.

    The result is one text per log (the feature), gathered from the log's kept
    lines: as many as its tail and the surroundings of its keyword lines.
    """
    g = kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("_l"))

    def piece(x, i):
        prev = F.when(i == 0, F.lit(-1)).otherwise(F.element_at(F.col("_l"), i)["line_no"])
        gap = x["line_no"] - prev - 1
        return F.when(gap > 0, F.concat(omitted_marker(gap), F.lit("\n"), x["line"])).otherwise(x["line"])

    return g.select(*keys, F.array_join(F.transform("_l", piece), "\n").alias("truncated"))


# --- L4 / L5 / L6 / L7 ------------------------------------------------------------------

_MATCH = "struct<ordinal:int,pattern:string,error_type:string,sql_state:string,match:string,groups:array<string>>"


def match_signatures(df: DataFrame, text: str, out: str = "regex_matches") -> DataFrame:
    """L4: first match of every signature (searching the whole text), as an
    array in declaration order; capture groups that did not take part are null."""
    t = F.col(text)
    items = []
    for i, (name, pat, etype, state) in enumerate(SIGNATURES):
        p = _FLAGS + pat
        m = F.regexp_extract(t, p, 0)
        groups = F.array(*[empty_to_null(F.regexp_extract(t, p, g)) for g in range(1, _group_count(pat) + 1)]) \
            if _group_count(pat) else F.array().cast("array<string>")
        items.append(F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("pattern"),
                              F.lit(etype).alias("error_type"), F.lit(state).cast("string").alias("sql_state"),
                              m.alias("match"), groups.alias("groups")))
    arr = F.filter(F.array(*items), lambda x: x["match"] != "")
    return df.withColumn(out, arr.cast(f"array<{_MATCH}>"))


def resolve_error(df: DataFrame, matches: str = "regex_matches") -> DataFrame:
    """The first match that carries a SQL state, else the first match."""
    m = F.col(matches)
    chosen = F.coalesce(F.try_element_at(F.filter(m, lambda x: x["sql_state"].isNotNull()), F.lit(1)),
                         F.try_element_at(m, F.lit(1)))
    return df.withColumn("error_type", chosen["error_type"]) \
        .withColumn("sql_state_code", chosen["sql_state"]) \
        .withColumn("error_message", chosen["match"])


def referenced_objects(df: DataFrame, text: str) -> DataFrame:
    """Distinct schema.table, column and model references, first-seen order."""
    t = F.col(text)
    schemas = F.regexp_extract_all(t, F.lit(_FLAGS + TABLE_REFERENCE), 1)
    names = F.regexp_extract_all(t, F.lit(_FLAGS + TABLE_REFERENCE), 2)
    tables = F.array_distinct(F.zip_with(schemas, names, lambda a, b: F.concat(a, F.lit("."), b)))
    cols = F.array_distinct(F.regexp_extract_all(t, F.lit(_FLAGS + COLUMN_REFERENCE), 1))
    models = F.array_distinct(F.regexp_extract_all(t, F.lit(_FLAGS + MODEL_REFERENCE), 1))
    return df.withColumn("tables", tables).withColumn("columns", cols).withColumn("models", models)


def extract_signals(df: DataFrame, text: str) -> DataFrame:
    """L4-L6 in one projection: matches, resolved error and references, all of
    the text as it comes in, also where it is the column ``error_message``."""
    return resolve_error(match_signatures(referenced_objects(df, text), text))


# --- L4 / L5 / L6 over line tables -------------------------------------------------------

# what every signature holds: lines without it are not searched
_ANY_SIGNATURE = _FLAGS + "(?:null value in column|invalid input syntax for type|does not exist|permission denied for|duplicate key value violates|Error in model)"
_ANY_REFERENCE = _FLAGS + "(?:relation|table|from|join|into|column|model)"


def line_matches(lines: DataFrame, keys: list[str]) -> DataFrame:
    """L4 over lines: the first match of every signature in each log, a row each.

    The first is a grouped minimum of the line number, so matches merge before the
    shuffle and a log is never one text. A match lies in one line: what ``[^"]+``
    or ``\\s+`` would span beyond a line break in a whole text is not found.
    """
    found = match_signatures(lines.where(F.col("line").rlike(_ANY_SIGNATURE)), "line", "_m")
    found = found.select(*keys, "line_no", F.explode("_m").alias("_m")).select(*keys, "line_no", "_m", F.col("_m.ordinal").alias("ordinal"))
    first = found.groupBy(*keys, "ordinal").agg(F.min_by("_m", "line_no").alias("_m"))
    return first.select(*keys, "_m.*")


def line_references(lines: DataFrame, keys: list[str]) -> DataFrame:
    """L6 over lines: (keys, kind, value, line_no, pos), each distinct object of a log where it is first seen."""
    t = F.col("line")
    schemas, names = (F.regexp_extract_all(t, F.lit(_FLAGS + TABLE_REFERENCE), g) for g in (1, 2))
    kinds = {"tables": F.zip_with(schemas, names, lambda a, b: F.concat(a, F.lit("."), b)), "columns": F.regexp_extract_all(t, F.lit(_FLAGS + COLUMN_REFERENCE), 1),
             "models": F.regexp_extract_all(t, F.lit(_FLAGS + MODEL_REFERENCE), 1)}

    def named(kind: str, values: Column) -> Column:
        return F.transform(values, lambda x, i: F.struct(F.lit(kind).alias("kind"), x.alias("value"), i.alias("pos")))

    held = F.concat(*[named(k, v) for k, v in kinds.items()])
    seen = lines.where(t.rlike(_ANY_REFERENCE)).select(*keys, "line_no", F.inline(held))
    return seen.groupBy(*keys, "kind", "value").agg(F.min(F.struct("line_no", "pos")).alias("at")).select(*keys, "kind", "value", "at.line_no", "at.pos")


def signals_of_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """L4-L6 for every log of a line table (keys, line_no, line): as ``extract_signals`` gives them for a text.

    What is gathered for a log are its first matches, one for each signature, and
    its distinct objects.
    """
    matches = line_matches(lines, keys)
    item = F.struct(*[F.col(c) for c in ("ordinal", "pattern", "error_type", "sql_state", "match", "groups")])
    matches = matches.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).cast(f"array<{_MATCH}>").alias("regex_matches"))
    seen = line_references(lines, keys)
    own = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("line_no", "pos", "value")))), lambda x: x["value"])
    objects = seen.groupBy(*keys).agg(*[own(k).alias(k) for k in ("tables", "columns", "models")])
    out = lines.select(*keys).distinct().join(matches, keys, "left").join(objects, keys, "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({"regex_matches": F.coalesce("regex_matches", F.array().cast(f"array<{_MATCH}>"))} | {k: F.coalesce(k, none) for k in ("tables", "columns", "models")})
    return resolve_error(out)


def merge_signals(df: DataFrame) -> DataFrame:
    """Merge model-extracted signals (``llm_*`` columns) with regex ones.

    Regex fills an empty error type / SQL state; object lists are unioned;
    with no extracted signals at all, the regex signals stand alone.
    """
    has_llm = F.col("llm_error_type").isNotNull() | F.col("llm_tables").isNotNull() | \
        F.col("llm_columns").isNotNull() | F.col("llm_models").isNotNull()
    e = F.array().cast("array<string>")

    def union(a, b):
        return F.when(has_llm, F.array_distinct(F.concat(F.coalesce(a, e), F.coalesce(b, e)))).otherwise(b)

    return df.withColumn("error_type", F.coalesce(empty_to_null(F.col("llm_error_type")), F.col("error_type"))) \
        .withColumn("sql_state_code", F.coalesce(empty_to_null(F.col("llm_sql_state")), F.col("sql_state_code"))) \
        .withColumn("tables", union(F.col("llm_tables"), F.col("tables"))) \
        .withColumn("columns", union(F.col("llm_columns"), F.col("columns"))) \
        .withColumn("models", union(F.col("llm_models"), F.col("models")))
