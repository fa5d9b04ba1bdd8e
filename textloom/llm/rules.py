"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.runtime import require

SYMBOLS = "#$%&*^~|<>{}[]=\\_@!"
MARKS = ".,;:!?\"()'"
STOP_WORDS = "the of and to in is that for it was on as with be by der die und in den von zu das mit sich des ist im dem nicht ein eine als auch de la que el en y a los se del las un por con no una su para es al le les des et du une est pour dans qui par sur pas au plus".split()

#: Rule, metric, least, most (None: open), and the words that a text must have for the rule to be asked.
#: A text that breaks any of them is not kept.
THRESHOLDS = [
    ("too_short", "n_words", 3, None, 0),
    ("too_long", "n_words", None, 1_000_000, 0),
    ("odd_word_length", "mean_word_length", 2.0, 15.0, 10),
    ("symbols", "symbol_ratio", None, 0.06, 0),
    ("few_letters", "letter_word_ratio", 0.7, None, 20),
    ("no_stop_words", "stop_word_ratio", 0.02, None, 30),
    ("bullets", "bullet_line_ratio", None, 0.9, 20),
    ("ellipses", "ellipsis_line_ratio", None, 0.3, 20),
]

_BREAK = "[ \\t\\n\\r]+"


def _sql(engine: str, text: str) -> dict[str, str]:
    """Each metric as an SQL expression; the two engines differ in how matches are counted and strings quoted."""
    spark = engine == "spark"

    def lit(s: str) -> str:
        return "'" + (s.replace("\\", "\\\\").replace("'", "\\'") if spark else s.replace("'", "''")) + "'"

    def count(where: str, pattern: str) -> str:
        return f"regexp_count({where}, {lit(pattern)})" if spark else f"len(regexp_extract_all({where}, {lit(pattern)}))"

    def swap(where: str, pattern: str, by: str) -> str:
        return f"regexp_replace({where}, {lit(pattern)}, {lit(by)})" if spark else f"regexp_replace({where}, {lit(pattern)}, {lit(by)}, 'g')"

    def dbl(x: str) -> str:
        return f"cast({x} as double)"

    bare = swap(text, _BREAK, "")
    words = count(text, "[^ \\t\\n\\r]+")
    low = f"concat('  ', {swap(f'lower(translate({text}, {lit(MARKS)}, {lit('')}))', _BREAK, '  ')}, '  ')"
    lines = count(text, "[^\\n]*[^ \\t\\n\\r][^\\n]*")
    return {
        "n_chars": f"cast(length({text}) as bigint)",
        "n_words": f"cast({words} as bigint)",
        "n_lines": f"cast({lines} as bigint)",
        "mean_word_length": f"{dbl(f'length({bare})')} / nullif({words}, 0)",
        "symbol_ratio": f"{dbl(f'length({text}) - length(translate({text}, {lit(SYMBOLS)}, {lit('')}))')} / nullif(length({bare}), 0)",
        "letter_word_ratio": f"{dbl(count(text, '[A-Za-zÀ-ÖØ-öø-ÿ][^ \\t\\n\\r]*'))} / nullif({words}, 0)",
        "stop_word_ratio": f"{dbl(count(low, f' (?:{'|'.join(STOP_WORDS)}) '))} / nullif({words}, 0)",
        "bullet_line_ratio": f"{dbl(count(text, '(?:^|\\n)[ \\t]*[-*•][ \\t]'))} / nullif({lines}, 0)",
        "ellipsis_line_ratio": f"{dbl(count(text, '(?:\\.\\.\\.|…)[ \\t]*(?:\\n|$)'))} / nullif({lines}, 0)",
    }


def _broken(metric: str, low, high, words: int) -> str:
    tests = ([f"{metric} < {low}"] if low is not None else []) + ([f"{metric} > {high}"] if high is not None else [])
    asked = f"n_words >= {words} and " if words else ""
    return f"coalesce({asked}({' or '.join(tests)}), true)"


def _decision(thresholds) -> tuple[str, str]:
    """SQL of the broken rules' names and of whether none is broken."""
    each = ", ".join(f"case when {_broken(*rule)} then '{name}' end" for name, *rule in thresholds)
    keep = " and ".join(f"not {_broken(*rule)}" for _, *rule in thresholds) or "true"
    return (f"concat_ws(',', {each})" if each else "''"), keep


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """(doc_id, the metrics, broken, kept): one projection over the scan, no shuffle, no user function.

    A metric that can't be had (null text, or no words to divide by) breaks its rules; so null, empty and blank texts
    are not kept. ``broken`` lists the broken rules in the table's order. Rows are judged one by one: repeated rows
    alike, null ids carried. Other columns are not read; an empty table gives an empty result.
    """
    require(docs, id_col, text_col)
    metrics = _sql("spark", "text")
    broken, keep = _decision(thresholds)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rounded = {k: (f"round({v}, 6)" if k.endswith(("ratio", "length")) else v) for k, v in metrics.items()}
    measured = texts.selectExpr("doc_id", *[f"{v} as {k}" for k, v in rounded.items()])
    return measured.selectExpr("*", f"{broken} as broken", f"{keep} as kept")


def oracle(table: str = "documents", thresholds=THRESHOLDS) -> str:
    metrics = _sql("duckdb", "text")
    broken, keep = _decision(thresholds)
    columns = ", ".join(f"{f'round({v}, 6)' if k.endswith(('ratio', 'length')) else v} as {k}" for k, v in metrics.items())
    return f"with m as (select doc_id, {columns} from {table}) select *, {broken} as broken, {keep} as kept from m"
