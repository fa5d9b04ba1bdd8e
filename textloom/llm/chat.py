"""Chat formatting: each dialogue from the perspective of each participant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.runtime import require

#: The role that speaks to all and is nobody's perspective.
SYSTEM = "system"
#: Ends each turn.
TAIL = "\n<|end|>\n"
_OWN = "<|assistant|>\n"


def escape(text: Column) -> Column:
    """The text with a backslash more inside whatever looks like the start of a marker; ``<|`` itself is left nowhere."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def name(role: Column) -> Column:
    """The role as it stands in a header: without ``|`` and line breaks, and different for different roles."""
    out = F.replace(role, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("|"), F.lit("\\p")), F.lit("\n"), F.lit("\\n"))


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, perspective, n_turns, rendered, turn_mask, spans, target_chars): a row for each speaker of each dialogue.

    In the rendering the speaker is ``assistant``, the system stays ``system``, and everybody else is a user named by
    their role. ``turn_mask`` has a 1 for each turn to be learnt, those of the speaker, and a 0 for the others;
    ``spans`` are "start:end" of the learnt contents in ``rendered``, in characters from 0, end exclusive. Whether a
    turn is the speaker's own is decided once, for its header and its mask. Nobody can write a marker: in texts
    ``<|`` becomes ``<\\|``, one backslash more where there are some, and names are written without ``|``.

    One shuffle, by conversation; perspectives are made within the row, in time that grows with its length. Turns go
    by number, then role, then text, nulls last; repeated rows are separate turns. A null role is a user without a
    name (``<|user|>``) and nobody's perspective, an empty one a speaker whose name is empty; a null or empty text is
    an empty turn. Very long texts and dialogues are rendered whole; a dialogue is one row, as its rendering is. Rows
    without a conversation id belong to no dialogue and are left out. A dialogue of the system alone gives no row, an
    empty table none. Other columns are not read, whatever their names.
    """
    require(turns, conv_col, turn_col, role_col, text_col)
    role = F.col("role")
    t = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")).filter("conv_id is not null")
    as_user = F.when(role.isNull(), "<|user|>\n").when(role == SYSTEM, "<|system|>\n").otherwise(F.concat(F.lit("<|user name="), name(role), F.lit("|>\n")))
    t = t.withColumn("head", as_user).withColumn("body", escape(F.coalesce("text", F.lit(""))))
    order = Window.partitionBy("conv_id").orderBy(*[F.asc_nulls_last(c) for c in ("turn", "role", "text")])
    long = F.length("head") + F.length("body") + len(TAIL)
    t = t.withColumn("k", F.row_number().over(order)).withColumn("at", F.coalesce(F.sum(long).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    grouped = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", "role", "head", "body", "at"))).alias("m"))
    speakers = F.array_sort(F.array_distinct(F.filter(F.transform("m", lambda x: x["role"]), lambda r: r.isNotNull() & (r != SYSTEM))))
    each = grouped.withColumn("perspective", F.explode(speakers))
    own = lambda x: x["role"].eqNullSafe(F.col("perspective"))
    each = each.withColumn("own", F.filter("m", own))

    def span(x, i):
        # all own headers before are longer or shorter than those of a user by the same
        begin = x["at"] + i * (len(_OWN) - F.length(x["head"])) + len(_OWN)
        return F.concat_ws(":", begin.cast("string"), (begin + F.length(x["body"])).cast("string"))

    return each.select(
        "conv_id",
        "perspective",
        F.size("m").cast("long").alias("n_turns"),
        F.array_join(F.transform("m", lambda x: F.concat(F.when(own(x), F.lit(_OWN)).otherwise(x["head"]), x["body"], F.lit(TAIL))), "").alias("rendered"),
        F.array_join(F.transform("m", lambda x: F.when(own(x), "1").otherwise("0")), "").alias("turn_mask"),
        F.array_join(F.transform("own", span), ",").alias("spans"),
        F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + F.length(x["body"])).alias("target_chars"),
    )


#: Written from the description above: every turn is rendered for every speaker, and places are sums of what was rendered.
ORACLE = r"""
with t as (
  select conv_id, role, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') as body,
         replace(replace(replace(role, '\', '\\'), '|', '\p'), chr(10), '\n') as shown,
         row_number() over (partition by conv_id order by turn nulls last, role nulls last, text nulls last) as k
  from conversations where conv_id is not null
), s as (select distinct conv_id, role as perspective from t where role is not null and role <> 'system'),
p as (
  select t.conv_id, perspective, k, body, role is not distinct from perspective as own,
         case when role is null then '<|user|>' when role = perspective then '<|assistant|>' when role = 'system' then '<|system|>'
              else '<|user name=' || shown || '|>' end || chr(10) as head
  from t join s on t.conv_id = s.conv_id
), q as (
  select *, head || body || chr(10) || '<|end|>' || chr(10) as whole,
         coalesce(sum(length(head) + length(body) + 9) over (partition by conv_id, perspective order by k rows between unbounded preceding and 1 preceding), 0) as pos
  from p
)
select conv_id, perspective, cast(count(*) as bigint) as n_turns, string_agg(whole, '' order by k) as rendered,
       string_agg(case when own then '1' else '0' end, '' order by k) as turn_mask,
       coalesce(string_agg(case when own then cast(cast(pos + length(head) as bigint) as varchar) || ':' || cast(cast(pos + length(head) + length(body) as bigint) as varchar) end, ',' order by k), '') as spans,
       cast(sum(case when own then length(body) else 0 end) as bigint) as target_chars
from q group by conv_id, perspective
"""
