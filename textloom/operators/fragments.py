"""Which of many fragments stand in which texts, in one pass over the texts."""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as tx

#: Characters of fragments whose automaton is sent to the workers at once; more take several passes.
CHARACTERS_AT_ONCE = 2_000_000


def texts_with_fragments(docs: DataFrame, fragments: DataFrame, id_col: str = "doc_id", text_col: str = "text", fragment_id: str = "item_id", fragment_col: str = "text") -> DataFrame:
    """(doc_id, fragment_id) of the fragments that stand in a text as they are, or both without accents.

    As ``has_fragment`` for all pairs, but texts are read once, by an automaton of the fragments, and no pair is
    formed that isn't found. Null texts and fragments are in nothing, an empty fragment is in every text.
    """
    kind, other = docs.schema[id_col].dataType.simpleString(), fragments.schema[fragment_id].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), tx.fold(text_col).alias("folded")).filter("text is not null")
    wanted = fragments.select(F.col(fragment_id).alias("i"), F.col(fragment_col).alias("t"), tx.fold(fragment_col).alias("f")).filter("t is not null")

    def pass_of(part):
        by: dict[str, set] = {}
        for i, t, f in part:
            by.setdefault(t, set()).add(i)
            by.setdefault(f, set()).add(i)
        everywhere = by.pop("", set())
        sent = docs.sparkSession.sparkContext.broadcast((by, everywhere))

        def run(batches):
            by, everywhere = sent.value
            machine = ahocorasick.Automaton()
            for t, ids in by.items():
                machine.add_word(t, ids)
            if by:
                machine.make_automaton()
            for batch in batches:
                row, found = [], []
                for k, (text, folded) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                    hits = set(everywhere)
                    for t in {text, folded} if by else ():
                        for _, ids in machine.iter(t):
                            hits |= ids
                    row += [k] * len(hits)
                    found += hits
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(row, np.int64))), pa.array(found, _ARROW.get(other, pa.string()))], ["doc_id", "fragment_id"])

        return texts.mapInArrow(run, f"doc_id {kind}, fragment_id {other}")

    out, part, size = None, [], 0
    for r in wanted.toLocalIterator():
        part.append(tuple(r))
        size += 2 * len(r.t)
        if size > CHARACTERS_AT_ONCE:
            found, part, size = pass_of(part), [], 0
            out = found if out is None else out.unionByName(found)
    if part or out is None:
        found = pass_of(part)
        out = found if out is None else out.unionByName(found)
    return out.distinct()


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
