"""Information-theoretic sanitisation: entities are masked, and terms that reveal them are generalised or removed."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import arrays as A
from textloom.runtime import materialise, require

_TITLE = r"(?:Mr|Mrs|Ms|Dr|Prof|Herrn?|Frau|Monsieur|Madame|Mme|Señora?|Sra?)\b\.?"
_STREET = r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Ct|Square|Way|Place)"
#: Kinds of protected entities, tried in this order at each place; ``\\d`` is a digit of any script.
ENTITIES = [
    ("SECRET", r"(?i:\b(?:token|secret|api[_-]?key|access[_-]?key|passw(?:or)?d|pwd)\b[\"']?\s*[=:]\s*)(?P<v1>\"[^\"\n]{6,}\"|'[^'\n]{6,}'|[^\s\"',;]{6,})"),
    ("SECRET", r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|[0-9a-f]{40}|[0-9a-f]{64})\b"),
    ("EMAIL", r"[^\s@<>()\[\]{},;:\"'|]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("IBAN", r"\b[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?\b"),
    ("IP", r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d]|\.\d)"),
    ("CARD", r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"),
    ("ID", r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"),
    ("PHONE", r"(?<![\d.])\+\d(?:[ ().-]{0,2}\d){7,14}(?!\d)|(?<![\d.-])\(?\d{2,4}\)?[ .-]\d{3,4}[ .-]\d{3,4}(?:[ .-]\d{2,4})?(?![\d-])|(?<!\d)0\d{8,11}(?!\d)"),
    ("ADDRESS", rf"(?<!\d)\d{{1,5}} (?:[A-Z][a-z]+ ){{1,3}}{_STREET}\b|\b[A-ZÄÖÜ][a-zäöüß-]*(?:straße|strasse|str\.|weg|platz|allee) \d{{1,4}}[a-z]?\b"),
    ("PERSON", rf"\b{_TITLE} (?P<v9>[^\W\d_a-zß-öø-ÿ][\w'’-]*(?: [^\W\d_a-zß-öø-ÿ][\w'’-]+){{0,2}})"),
]
#: Whatever may hold an entity, in the syntax of Arrow's linear-time engine; texts without a match have none.
SUSPECT = (
    r"@|\p{Nd}[\p{Nd} ().+-]{5,}\p{Nd}|(?i:token|secret|key|passw|pwd)|[0-9a-f]{40}|AKIA|gh[pousr]_|sk-|[A-Z]{2}[0-9]{2}"
    r"|\p{Nd} [A-Z]|(?:straße|strasse|str\.|weg|platz|allee) \p{Nd}|" + _TITLE.replace(r"\b", "") + " "
)
#: Texts that an entity and a term must share before the pair is weighed.
SUPPORT = 1
#: A term discloses an entity when their pointwise mutual information reaches this share of the entity's information.
DISCLOSURE = 0.8
#: Candidate terms whose text counts are taken in one pass (9 bytes each at a worker).
TERMS_AT_ONCE = 4_000_000

#: Distinct terms that a task holds before it passes their counts on.
_HELD = 2_000_000
#: What a masked place looks like.
_PLACE = re.compile(rb"\[(?:NAME|NUMBER|" + "|".join(sorted({k for k, _ in ENTITIES})).encode() + rb")\]")

_EACH = [re.compile(p) for _, p in ENTITIES]
#: The start of a number; entities of digits are tried only there.
_NUMBER = re.compile(r"[+(\d]")
_NUMERIC = {k for k, (kind, _) in enumerate(ENTITIES) if kind in ("IP", "CARD", "ID", "PHONE")}
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[\s@<>()\[\]{},;:\"'|]")
_KEYWORD = re.compile("(?i:token|secret|key|passw|pwd)")
_TITLED = re.compile(_TITLE)
_TABLE_BITS = 22


def _next(k: int, text: str, at: int) -> tuple[int, int, int, int] | None:
    """Start and end of the match, and of what is masked of it, of the kind's first match from a place on."""
    kind = ENTITIES[k][0]
    if kind == "EMAIL":
        for m in _AT.finditer(text, at):
            begin = m.start()
            while begin > at and not _NOT_LOCAL.match(text[begin - 1]):
                begin -= 1
            if begin < m.start():
                return begin, m.end(), begin, m.end()
        return None
    if k in _NUMERIC:
        m = next((m for c in _NUMBER.finditer(text, at) if (m := _EACH[k].match(text, c.start()))), None)
    else:
        m = _EACH[k].search(text, at)
    if m is None:
        return None
    return (*m.span(), *(m.span("v1") if k == 0 else m.span("v9") if kind == "PERSON" else m.span()))


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) from left to right, the first kind of ENTITIES among those that start together.

    Of a key with its secret only the secret, of a title with its name only the name.
    """
    digits = _NUMBER.search(text) is not None
    open_ = {k: None for k, (kind, _) in enumerate(ENTITIES) if (digits if k in _NUMERIC or kind in ("ADDRESS", "IBAN") else True)}
    if 0 in open_ and not _KEYWORD.search(text):
        del open_[0]
    if "@" not in text:
        del open_[2]
    if not _TITLED.search(text):
        del open_[9]
    out, at = [], 0
    while open_:
        for k, m in list(open_.items()):
            if m is None or m[0] < at:
                m = open_[k] = _next(k, text, at)
                if m is None:
                    del open_[k]
        if open_:
            k, (begin, end, a, b) = min(open_.items(), key=lambda x: (x[1][0], x[0]))
            out.append((a, b, ENTITIES[k][0], text[a:b].strip("\"'").lower()))
            at = max(end, begin + 1)
    return out


def suspect(texts: pa.Array) -> np.ndarray:
    """Which of the texts may hold an entity."""
    return np.asarray(pc.fill_null(pc.match_substring_regex(texts, SUSPECT), False))


def hash_words(words: list[bytes]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size)
    return A.span_hashes(np.frombuffer(b"".join(words), np.uint8), ends - size, ends)


def _entity_hash(kind: str, value: str) -> int:
    return int(hash_words([f"{kind}:{value}".encode()])[0])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in its row's bytes, the row, and the hash of the lower-case form.

    Lower case turns word bytes into word bytes, so the words of both forms correspond one by one.
    """
    data, offs = A.text_bytes(texts)
    a, b, row = A.word_spans(data, offs)
    low, low_offs = A.text_bytes(pc.utf8_lower(texts))
    x, y, _ = A.word_spans(low, low_offs)
    return a - offs[row], b - offs[row], row, A.span_hashes(low, x, y)


def _byte_spans(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int]]:
    at, place, out = 0, 0, []
    for a, b, _, _ in found:
        begin = at + len(text[place:a].encode())
        at, place = begin + len(text[a:b].encode()), b
        out.append((begin, at))
    return out


def _free(a: np.ndarray, b: np.ndarray, taken: list[tuple[int, int]]) -> np.ndarray:
    """Which of the spans touch none of the (sorted, disjoint) ``taken`` ones."""
    if not taken:
        return np.ones(len(a), bool)
    starts, ends = np.array(taken).T
    return np.searchsorted(ends, a, side="right") == np.searchsorted(starts, b, side="left")


def term_counts(texts: DataFrame) -> DataFrame:
    """(term, n_term): in how many texts each word occurs; a task adds up its own counts before they are shuffled."""

    def merge(parts):
        h, n = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(h)
        h, n = h[order], n[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        return h[first], np.add.reduceat(n, first)

    def batch_of(h, n):
        return pa.RecordBatch.from_arrays([_signed(h), pa.array(n)], ["term", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for s in A.slices(batch, "text"):
                _, _, row, h = _words(A.column(s, "text"))
                if len(h) == 0:
                    continue
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                once = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]
                first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                held.append((h[first], np.add.reduceat(once.astype(np.int64), first)))
                size += len(first)
                if size > _HELD:
                    held = [merge(held)]
                    size = len(held[0][0])
                    if size > _HELD:
                        yield batch_of(*held[0])
                        held, size = [], 0
        if held:
            yield batch_of(*merge(held))

    return texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))


def disclosing_terms(texts: DataFrame, support: int) -> DataFrame:
    """(term) of the words that disclose some entity, by their co-occurrence over whole texts.

    Of each text with entities every distinct word is weighed with every distinct entity. Nothing is collected.
    """

    def extract(batches):
        for batch in batches:
            for s in A.slices(batch, "text"):
                column = A.column(s, "text")
                column = column.filter(pa.array(suspect(column)))
                a, b, row, h = _words(column)
                first = A.row_starts(row, len(column))
                for k, text in enumerate(column.to_pylist()):
                    found = entities(text)
                    if not found:
                        continue
                    part = slice(first[k], first[k + 1])
                    terms = _signed(np.unique(h[part][_free(a[part], b[part], _byte_spans(text, found))]))
                    terms = pa.concat_arrays([terms, pa.nulls(1, pa.int64())])
                    for e in sorted({_entity_hash(kind, v) for _, _, kind, v in found}):
                        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(e - (1 << 64) if e >> 63 else e, pa.int64()), len(terms)), terms], ["entity", "term"])

    pairs = texts.mapInArrow(extract, "entity long, term long").groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    pairs = materialise(pairs, "pii-pairs")
    n = float(max(texts.count(), 1))
    entity = pairs.filter("term is null").select("entity", F.col("n_both").alias("n_entity"))
    both = pairs.filter("term is not null").filter(F.col("n_both") >= support)
    weighed = both.join(entity, "entity").join(term_counts(texts), "term")
    pmi = F.log2(F.lit(n) * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    information = F.log2(F.lit(n) / F.col("n_entity"))
    return weighed.filter((information > 0) & (pmi >= DISCLOSURE * information)).select("term").distinct()


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT) -> DataFrame:
    """(doc_id, text, n_entities, n_terms), one row for each row of ``docs``: what identifies people is taken out.

    Addresses, numbers, secrets and titled names (ENTITIES) are masked by their kind. Every word of a text with
    entities is weighed with each of them, if they share ``support`` texts; it discloses the entity when their
    pointwise mutual information over all texts reaches 0.8 of the entity's information, that is when seeing the word
    nearly gives the entity away. Disclosing words are taken out of all texts, also of those without any entity: they
    become [NAME] (capital) or [NUMBER], or are removed.

    Counts stay with the executors, added up by task before they are shuffled. Disclosing terms are sent to the
    workers TERMS_AT_ONCE at a time, each part in a pass over the texts. Null texts stay null with null counts, empty
    ones stay empty, very long ones are weighed and masked whole. Repeated rows are rows of their own, and count as
    texts; ties don't matter, as every term is judged by itself. Null ids are carried; other columns are not read,
    whatever their names. An empty table gives an empty one.
    """
    require(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    terms = materialise(disclosing_terms(texts.select("text").filter("text is not null"), support), "pii-terms")
    parts = max(1, -(-terms.count() // TERMS_AT_ONCE))
    out = texts.select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), F.lit(0).cast("long").alias("n_terms"))
    schema = f"doc_id {kind}, text string, n_entities long, n_terms long"
    for k in range(parts):
        part = np.sort(terms.filter(F.pmod("term", F.lit(parts)) == k).toArrow().column("term").to_numpy().view(np.uint64))
        table = np.zeros(1 << _TABLE_BITS, bool)
        table[part >> np.uint64(64 - _TABLE_BITS)] = True
        sent = texts.sparkSession.sparkContext.broadcast((part, table))

        def mask(batches, sent=sent, k=k):
            part, table = sent.value
            for batch in batches:
                for s in A.slices(batch, "text"):
                    column = A.column(s, "text")
                    a, b, row, h = _words(column)
                    hit = np.flatnonzero(table[h >> np.uint64(64 - _TABLE_BITS)])
                    if len(hit):
                        slot = np.searchsorted(part, h[hit])
                        slot[slot == len(part)] = 0
                        hit = hit[part[slot] == h[hit]]
                    a, b, first = a[hit], b[hit], A.row_starts(row[hit], s.num_rows)
                    maybe = suspect(column) if k == 0 else np.zeros(len(column), bool)
                    done, n_entities, n_terms = column.to_pylist(), A.column(s, "n_entities").to_pylist(), A.column(s, "n_terms").to_pylist()
                    for i, text in enumerate(done):
                        if text is None:
                            n_entities[i] = n_terms[i] = None
                            continue
                        found = entities(text) if maybe[i] else []
                        if not found and first[i] == first[i + 1]:
                            continue
                        raw = text.encode()
                        taken = _byte_spans(text, found) if k == 0 else [m.span() for m in _PLACE.finditer(raw)]
                        cuts = {x: f"[{kind}]".encode() for x, (_, _, kind, _) in zip(taken, found)}
                        x, y = a[first[i] : first[i + 1]], b[first[i] : first[i + 1]]
                        ok = _free(x, y, taken)
                        for span in zip(x[ok].tolist(), y[ok].tolist()):
                            word = raw[slice(*span)].decode()
                            cuts[span] = b"[NUMBER]" if word.isdigit() else b"[NAME]" if word[:1].isupper() else b""
                        pieces, last = [], 0
                        for (x, y), by in sorted(cuts.items()):
                            pieces += [raw[last:x], by]
                            last = y + (by == b"" and raw[y : y + 1] == b" ")
                        done[i] = b"".join([*pieces, raw[last:]]).decode()
                        n_entities[i] += len(found)
                        n_terms[i] += len(cuts) - len(found)
                    yield pa.RecordBatch.from_arrays([A.column(s, "doc_id"), pa.array(done, pa.string()), pa.array(n_entities, pa.int64()), pa.array(n_terms, pa.int64())], ["doc_id", "text", "n_entities", "n_terms"])

        out = out.mapInArrow(mask, schema)
        if k + 1 < parts:
            out = materialise(out, "pii-masked")
    return out
