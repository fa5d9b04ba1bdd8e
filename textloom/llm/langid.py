"""Language ID: text likelihoods fused with declared markup language, address suffix and smoothed host priors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import arrays as A
from textloom.runtime import materialise, require, sent_if_small

#: Labelled rows that the text model is fitted on, at most; they are those of the smallest hashes of their ids.
SAMPLE_ROWS = 8_000
BUCKETS = 1 << 16
#: Trigrams overlap, so each counts for a third of its evidence.
TEMPER = 1 / 3
#: Chance that markup and suffix tell the truth; the rest is spread over the other languages.
MARKUP_TRUTH, SUFFIX_TRUTH = 0.85, 0.7
#: Rows that a host's prior takes from its domain, and a domain's from the whole corpus.
HOST_WEIGHT, DOMAIN_WEIGHT = 20.0, 50.0
MIN_POSTERIOR = 0.5
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh", "kr": "ko"}

_LETTER = np.full(256, 32, np.uint8)
_LETTER[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]


def trigrams(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the byte trigrams of lower-case letters, words apart by one space, and the rows."""
    data, offs = A.text_bytes(pc.utf8_lower(arr))
    n = len(arr)
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(offs))
    # a space before and after each text
    padded = np.full(len(data) + 2 * n, 32, np.uint8)
    padded[np.arange(len(data)) + 2 * row + 1] = _LETTER[data]
    rows = np.repeat(np.arange(n, dtype=np.int32), np.diff(offs) + 2)
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 32) | (padded[:-1] != 32) | (rows[1:] != rows[:-1])
    s, rows = padded[keep].astype(np.uint32), rows[keep]
    if len(s) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    code = (s[:-2] << np.uint32(16)) | (s[1:-1] << np.uint32(8)) | s[2:]
    ok = rows[:-2] == rows[2:]
    return ((code[ok] * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64), rows[:-2][ok]


@dataclass
class TextModel:
    """log p(trigram bucket | language), one column a language."""

    languages: list[str]
    logs: np.ndarray

    def score(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(n, languages) sums of log-likelihoods, and the number of trigrams of each row."""
        bucket, row = trigrams(arr)
        n = len(arr)
        out = np.zeros((n, len(self.languages)))
        first = A.row_starts(row, n)
        some = np.flatnonzero(np.diff(first))
        if len(some):
            out[some] = np.add.reduceat(self.logs[bucket], first[some], axis=0, dtype=np.float64)
        return out, np.diff(first)


def fit_text_model(labelled: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int = SAMPLE_ROWS) -> TextModel:
    """Trigram counts by language of labelled rows, half a count added to each bucket.

    The sample is the rows of the ``sample_rows`` smallest hashes of ids, ties by id. Rows without id, text or label
    are left out, empty texts count nothing, very long ones are counted whole; rows that repeat an id are all taken.
    Without labelled rows the model has no language. Other columns are not read, whatever their names.
    """
    known = labelled.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(label_col).cast("string").alias("l")).na.drop()
    picked = known.select(F.col("i").alias("picked")).distinct().orderBy(F.xxhash64("picked"), "picked").limit(sample_rows)
    sample = known.join(F.broadcast(picked), known["i"] == picked["picked"], "left_semi")

    def count(batches):
        for batch in batches:
            for s in A.slices(batch, "text"):
                bucket, row = trigrams(A.column(s, "text"))
                labels = A.column(s, "label").dictionary_encode()
                code = labels.indices.to_numpy(zero_copy_only=False)[row] if len(row) else row
                key, n = np.unique(code.astype(np.int64) * BUCKETS + bucket, return_counts=True)
                yield pa.RecordBatch.from_arrays([labels.dictionary.take(pa.array(key // BUCKETS)).cast(pa.string()), pa.array(key % BUCKETS), pa.array(n)], ["label", "bucket", "n"])

    pairs = sample.select(F.col("t").alias("text"), F.col("l").alias("label"))
    counts = pairs.mapInArrow(count, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counts.column("label").to_pylist()))
    table = np.full((BUCKETS, len(languages)), 0.5)
    at = {x: i for i, x in enumerate(languages)}
    np.add.at(table, (counts.column("bucket").to_numpy(), np.array([at[x] for x in counts.column("label").to_pylist()], np.int64)), counts.column("n").to_numpy())
    return TextModel(languages, np.log(table / table.sum(axis=0)).astype(np.float32))


def _parent(host: Column) -> Column:
    """The last two labels of a host name; a name without dots is its own domain."""
    return F.regexp_extract(host, r"([^.]+\.[^.]+|[^.]+)$", 1)


def identify(
    docs: DataFrame,
    model: TextModel,
    id_col: str = "doc_id",
    text_col: str = "text",
    host: Column | None = None,
    markup: Column | None = None,
    suffix: Column | None = None,
    min_posterior: float = MIN_POSTERIOR,
) -> DataFrame:
    """(doc_id, text_lang, lang_id, posterior, rejected, text_hash), one row for each row of ``docs``.

    Posterior = host prior x text likelihood x p(markup | language) x p(suffix | language), normalised. Texts are
    scored in one pass; the host priors are grouped sums of the texts' own posteriors, by host, by domain and over
    all, each level smoothed with the one above, and come back by a join on the host. A text is rejected when no
    language reaches ``min_posterior``, when it is less likely under every language than trigrams drawn at random,
    or when it has no letters and nothing else speaks for a language.

    Very long texts are scored whole. Null and empty texts have no likelihood: their markup, suffix and host decide, and they are rejected if all of
    these are missing. A missing or unknown markup, suffix or host is no evidence. Ties go to the language first in
    the alphabet. Repeated rows are answered alike; null ids are carried. Other columns are not read. Without any
    labelled language (an empty model) every row is rejected with a null language.
    """
    require(docs, id_col, text_col)
    langs = model.languages
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    none = F.lit(None).cast("string")
    source = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"),
        (none if host is None else host.cast("string")).alias("host"), (none if markup is None else F.lower(F.substring(markup.cast("string"), 1, 2))).alias("markup"), (none if suffix is None else F.lower(suffix.cast("string"))).alias("suffix"),
    )

    def run(batches):
        for batch in batches:
            for s in A.slices(batch, "text"):
                logs, n = sent.value.score(A.column(s, "text"))
                noise = (logs.max(axis=1) < -np.log(BUCKETS) * n) & (n > 0)
                logs *= TEMPER
                own = np.exp(logs - logs.max(axis=1, keepdims=True))
                own /= own.sum(axis=1, keepdims=True)
                ends = pa.array(np.arange(len(logs) + 1, dtype=np.int32) * len(langs))
                names = ["doc_id", "text_hash", "host", "markup", "suffix"]
                yield pa.RecordBatch.from_arrays(
                    [*(A.column(s, x) for x in names), pa.ListArray.from_arrays(ends, pa.array(logs.ravel())), pa.ListArray.from_arrays(ends, pa.array(own.ravel())), pa.array(n.astype(np.int64)), pa.array(noise)],
                    [*names, "logs", "own", "grams", "noise"],
                )

    if not langs:
        return source.select("doc_id", none.alias("text_lang"), none.alias("lang_id"), F.lit(0.0).alias("posterior"), F.lit(True).alias("rejected"), "text_hash")
    scored = source.mapInArrow(A.released(run), f"doc_id {kind}, text_hash long, host string, markup string, suffix string, logs array<double>, own array<double>, grams long, noise boolean")

    own = materialise(scored, "langid")
    each = range(len(langs))
    host_sums = own.filter("grams > 0 and host is not null").groupBy("host").agg(*[F.sum(F.col("own")[i]).alias(f"h{i}") for i in each]).withColumn("domain", _parent(F.col("host")))
    domain_sums = host_sums.groupBy("domain").agg(*[F.sum(f"h{i}").alias(f"d{i}") for i in range(len(langs))])
    total = own.filter("grams > 0").agg(*[F.coalesce(F.sum(F.col("own")[i]), F.lit(0.0)).alias(f"g{i}") for i in each]).first()
    every = sum(total)
    broad = [(g + 1) / (every + len(langs)) for g in total]
    d_all = sum((F.col(f"d{i}") for i in range(1, len(langs))), F.col("d0"))
    domains = domain_sums.select("domain", *[((F.col(f"d{i}") + DOMAIN_WEIGHT * broad[i]) / (d_all + DOMAIN_WEIGHT)).alias(f"q{i}") for i in range(len(langs))])
    h_all = sum((F.col(f"h{i}") for i in range(1, len(langs))), F.col("h0"))
    smoothed = F.array(*[(F.col(f"h{i}") + HOST_WEIGHT * F.col(f"q{i}")) / (h_all + HOST_WEIGHT) for i in each])
    priors = host_sums.join(domains, "domain").select(F.col("host").alias("__host"), smoothed.alias("prior"))
    joined = own.join(priors, own["host"] == priors["__host"], "left")
    others = max(1, len(langs) - 1)

    def evidence(says: Column, truth: float, i: int) -> Column:
        return F.when(says.isin(langs), F.log(F.when(says == langs[i], F.lit(truth)).otherwise(F.lit((1 - truth) / others)))).otherwise(F.lit(0.0))

    def named(weights: str) -> Column:
        """The language of the greatest weight, the first in the alphabet among equals."""
        return F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position(weights, F.array_max(weights)).cast("int"))

    of_suffix = F.create_map(*[F.lit(x) for p in SUFFIXES.items() for x in p])
    told = joined.withColumn("ending", F.try_element_at(of_suffix, F.coalesce("suffix", F.lit("")))).withColumn("prior", F.coalesce("prior", F.array(*[F.lit(x) for x in broad])))
    fused = told.withColumn("logs", F.array(*[F.log(F.col("prior")[i]) + F.col("logs")[i] + evidence(F.col("markup"), MARKUP_TRUTH, i) + evidence(F.col("ending"), SUFFIX_TRUTH, i) for i in each]))
    fused = fused.withColumn("top", F.array_max("logs")).withColumn("weights", F.transform("logs", lambda x: F.exp(x - F.col("top"))))
    fused = fused.withColumn("posterior", F.lit(1.0) / F.aggregate("weights", F.lit(0.0), lambda a, x: a + x))
    dumb = (F.col("grams") == 0) & F.col("__host").isNull() & ~F.coalesce(F.col("markup").isin(langs), F.lit(False)) & ~F.coalesce(F.col("ending").isin(langs), F.lit(False))
    return fused.select(
        "doc_id",
        F.when(F.col("grams") > 0, named("own")).alias("text_lang"),
        F.when(~dumb, named("weights")).alias("lang_id"),
        F.round("posterior", 6).alias("posterior"),
        ((F.col("posterior") < min_posterior) | F.col("noise") | dumb).alias("rejected"),
        "text_hash",
    )


def identify_documents(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``identify`` over ``documents``: the source is the host, and the labels are those of ``labelled`` (or ``docs``).

    Nulls, empty and very long texts, ties, repeated rows, empty tables and other columns as in ``identify``.
    """
    model = fit_text_model(docs if labelled is None else labelled, "doc_id", "text", "lang")
    return identify(docs, model, host=F.col("source"))


def identify_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    """``identify`` over ``pages``: visible text, the html element's lang, the address's suffix and host.

    A null page or address has no text or host; all else as in ``identify``.
    """
    html = F.col("html")
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>", " ")
    host = F.nullif(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1), F.lit(""))
    view = pages.select(F.col("page_id").alias("doc_id"), text.alias("text"), F.regexp_replace(F.lower(host), r"^(www|m)\.", "").alias("host"), F.nullif(F.regexp_extract(html, r"(?i)<html[^>]*\blang=[\"']?([A-Za-z]+)", 1), F.lit("")).alias("markup"), F.regexp_extract(host, r"\.([A-Za-z]+)$", 1).alias("suffix"))
    out = identify(view, model, host=F.col("host"), markup=F.col("markup"), suffix=F.col("suffix"))
    return out.withColumnRenamed("doc_id", "page_id")


def drop_rejected(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is found, with all their columns, whatever their names.

    Null and empty texts go unless their source speaks for a language, as ``identify`` has it; very long texts are
    scored whole; repeated rows go or stay together, ties between languages don't matter here. An empty table gives
    an empty one.
    """
    bad = materialise(identify_documents(docs).filter("rejected").select(F.col("doc_id").alias("i"), F.col("text_hash").alias("h")).distinct(), "langid-rejected")
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, text = F.col(f"c{names.index('doc_id')}"), F.col(f"c{names.index('text')}").cast("string")
    return plain.join(sent_if_small(bad), key.eqNullSafe(bad["i"]) & F.xxhash64(text).eqNullSafe(bad["h"]), "left_anti").toDF(*names)
