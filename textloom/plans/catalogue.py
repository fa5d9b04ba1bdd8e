"""The queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import dates, fuzzy, language
from textloom.functions import text as tx
from textloom.operators import clustering, cooccurrence, decomposition, fragments, irr, pmi, sampling, similarity, tfidf, topics
from textloom.runtime import materialise, sent_if_small, spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

STOP = tuple(tx.stopwords())


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def table(spark, sf_dir, name):
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


# Sql that several oracles share

_TOKEN = r"[\p{L}\p{N}_]{2,}"
_STOP_SQL = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP) + ")"


def tok(source: str = "documents", key: str = "doc_id", stop: bool = False, bigrams: bool = False, name: str = "tok") -> str:
    w = f"regexp_extract_all(lower(text), '{_TOKEN}')"
    if stop:
        w = f"list_filter({w}, lambda x: x not in {_STOP_SQL})"
    if bigrams:
        return f"{name}0 as (select {key} as doc_id, {w} as w from {source} where text is not null), {name} as (select doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from {name}0)"
    return f"{name} as (select {key} as doc_id, unnest({w}) as term from {source} where text is not null)"


def weights(min_df: str = "df >= 1", source: str = "documents", **options) -> str:
    return f"""{tok(source, **options)},
tf as (select doc_id, term, count(*) as tf from tok group by all),
n as (select count(*) as n from {source} where text is not null),
voc as (select term, count(*) as df from tf group by term having {min_df}),
raw as (select doc_id, tf.term, tf, df, tf * (ln((n + 1.0) / (df + 1)) + 1) as w0 from tf join voc on tf.term = voc.term, n),
post as (select doc_id, term, tf, df, w0 / sqrt(sum(w0 * w0) over (partition by doc_id)) as weight from raw)"""


def post_of(other: str, key: str, name: str) -> str:
    """Postings of another table over the documents' vocabulary."""
    return f"""{tok(other, key, name=f"tok_{name}")},
tf_{name} as (select doc_id, term, count(*) as tf from tok_{name} group by all),
raw_{name} as (select doc_id, t.term, tf * (ln((n + 1.0) / (df + 1)) + 1) as w0 from tf_{name} t join voc on t.term = voc.term, n),
{name} as (select doc_id as item, term, w0 / sqrt(sum(w0 * w0) over (partition by doc_id)) as qw from raw_{name})"""


# Text


@query("select doc_id, item_id from documents d, benchmark b where contains(strip_accents(d.text), strip_accents(b.text))")
def has_fragment_benchmark(spark, sf_dir):
    return fragments.texts_with_fragments(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("fragment_id", "item_id")


@query("select a.item_id as a, b.item_id as b, contains(strip_accents(a.text), strip_accents(left(b.text, 12))) as has from benchmark a join benchmark b on true")
def has_fragment_pairs(spark, sf_dir):
    """The column expression, for every item and the beginning of every other."""
    t = table(spark, sf_dir, "benchmark")
    a, b = t.select(F.col("item_id").alias("a"), F.col("text").alias("x")), t.select(F.col("item_id").alias("b"), F.substring("text", 1, 12).alias("y"))
    return a.join(F.broadcast(b)).select("a", "b", tx.has_fragment("x", "y").alias("has"))


@query("select doc_id, case when replace(a, ' der ', '') = '' then a else replace(a, ' der ', '') end as text from (select doc_id, case when replace(text, ' the ', '') = '' then text else replace(text, ' the ', '') end as a from documents)")
def remove_fragments_basic(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.remove_fragments("text", [" the ", " der "]).alias("text"))


_CLEAN = """select {key}, array_to_string(list_filter(regexp_extract_all(lower(strip_accents(text)), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 3 and w not in {stop} and not regexp_matches(w, '[0-9]')), ' ') as clean from {table}"""


_URL_SQL = r"(select * replace (regexp_replace(text, '(?i)\b(https?://|www\.)[^\s<>\"'']+', ' ', 'g') as text) from {0})"


@query(_CLEAN.format(key="doc_id", stop=_STOP_SQL, table=_URL_SQL.format("documents")))
def clean_basic(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.clean("text").alias("clean"))


_SAYS = "I won't say it's fine; you'd better ask whether they can't come, as we've WON'T said they're ain't, she'll know. See https://example.org/a?b=c and www.example.com now. "
_SAYS_SQL = _SAYS.replace("'", "''")
_EXPAND = r"""case w when 'won''t' then 'will_not' when 'can''t' then 'cannot' when 'i''m' then 'i am' when 'ain''t' then 'is not' when 'it''s' then 'it is' else
  case when regexp_full_match(w, '[a-z]+''ll') then w[:-4] || ' will' when regexp_full_match(w, '[a-z]+n''t') then w[:-4] || '_not' when regexp_full_match(w, '[a-z]+''ve') then w[:-4] || ' have'
       when regexp_full_match(w, '[a-z]+''re') then w[:-4] || ' are' when regexp_full_match(w, '[a-z]+''d') then w[:-3] || ' would' else replace(w, chr(39), ' ') end end"""


@query(rf"""with t as (select doc_id, regexp_extract_all(regexp_replace(lower(strip_accents('{_SAYS_SQL}' || text)), '\b(https?://|www\.)[^\s<>"'']+', ' ', 'g'), '[\p{{L}}\p{{N}}_'']+') as ws from documents where text is not null),
e as (select doc_id, string_split(array_to_string([{_EXPAND} for w in ws], ' '), ' ') as ws from t)
select doc_id, array_to_string([w for w in ws if length(w) >= 3 and w not in {_STOP_SQL} and not regexp_matches(w, '[0-9]')], ' ') as clean from e""")
def clean_contractions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", tx.clean(F.concat(F.lit(_SAYS), "text")).alias("clean"))


@query(_CLEAN.format(key="conv_id, turn", stop=_STOP_SQL, table="conversations"))
def clean_conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.clean("text").alias("clean"))


@query()
def clean_stemmed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.clean("text", process=language.stem_words).alias("clean"))


_STRIP = r"""
select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\n\r\f]+', ' ', 'g')) as text from pages
"""


@query(_STRIP)
def strip_html_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.strip_html("html").alias("text"))


_SENT = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) >= {n})"


@query(f"select doc_id, cast(len({_SENT.format(n=20)}) as bigint) as sentences, coalesce(cast(list_sum(list_transform({_SENT.format(n=20)}, lambda s: length(s))) as bigint), 0) as chars from documents")
def sentence_counts(spark, sf_dir):
    s = tx.sentences("text", 20)
    lengths = F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("sentences"), lengths.alias("chars"))


@query("select a.p_partkey as a, b.p_partkey as b, round(100.0 * (1 - levenshtein(a.p_name, b.p_name) / cast(greatest(length(a.p_name), length(b.p_name)) as double)), 6) as ratio from part a join part b on a.p_brand = b.p_brand and a.p_size = b.p_size and a.p_partkey < b.p_partkey")
def edit_ratio_ascii(spark, sf_dir):
    """Parts have few different names, so each two of these are compared once, and what they give goes to the pairs of parts."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey", "p_name")
    names = materialise(p.select("p_name").distinct(), "names")
    ratios = names.toDF("x").crossJoin(names.toDF("y")).select("x", "y", F.round(fuzzy.edit_ratio("x", "y"), 6).alias("ratio"))
    ratios = sent_if_small(materialise(ratios, "name-ratios"))
    a, b = p.toDF("p_brand", "p_size", "a", "x"), p.toDF("p_brand", "p_size", "b", "y")
    return a.join(b, ["p_brand", "p_size"]).filter("a < b").join(ratios, ["x", "y"], "left").select("a", "b", "ratio")


_NAMES = "n as (select distinct p_name as x from part)"
#: Longest common subsequence of short strings, row by row over the bits of the first: the same recurrence in SQL integers.
_LCS = "(length({a}) - bit_count(list_reduce([list_reduce([case when substr({a}, i, 1) = substr({b}, j, 1) then 1::hugeint << (i - 1) else 0::hugeint end for i in range(1, length({a}) + 1)], lambda p, q: p | q, 0::hugeint) for j in range(1, length({b}) + 1)], lambda r, m: ((r + (r & m)) | (r - (r & m))) & ((1::hugeint << length({a})) - 1), (1::hugeint << length({a})) - 1)))"


def _name_pairs(spark, sf_dir):
    """All pairs of the part table's few different names."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return names.select(F.col("p_name").alias("a")).join(F.broadcast(names.select(F.col("p_name").alias("b"))))


@query(f"with {_NAMES} select n.x as a, m.x as b, round(200.0 * {_LCS.format(a='n.x', b='m.x')} / (length(n.x) + length(m.x)), 6) as ratio from n join n m on true")
def fuzzy_ratio_names(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("a", "b", F.round(fuzzy.fuzzy_ratio("a", "b"), 6).alias("ratio"))


@query(f"""with {_NAMES}, p as (select n.x as a, m.x as b, case when length(n.x) <= length(m.x) then n.x else m.x end as s, case when length(n.x) <= length(m.x) then m.x else n.x end as l from n join n m on true),
w as (select a, b, s, substr(l, pos, length(s)) as part from (select *, unnest(range(1, length(l) - length(s) + 2)) as pos from p))
select a, b, round(max(100.0 * {_LCS.format(a='s', b='part')} / length(s)), 6) as ratio from w group by a, b""")
def fuzzy_partial_ratio_names(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("a", "b", F.round(fuzzy.fuzzy_partial_ratio("a", "b"), 6).alias("ratio"))


@query(f"""with {_NAMES}, p as (select n.x as a, m.x as b from n join n m on true), s as (select a, b, i, unnest(range(1, length(a) - i + 2)) as size from (select *, unnest(range(1, length(a) + 1)) as i from p)),
c as (select *, substr(a, i, size) as part from s where contains(b, substr(a, i, size)))
select p.a, p.b, coalesce(arg_max(part, size * 1000 - i), '') as overlap from p left join c on p.a = c.a and p.b = c.b group by p.a, p.b""")
def largest_overlap_names(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("a", "b", fuzzy.largest_overlap("a", "b").alias("overlap"))


@query()
def raw_overlaps_turns(spark, sf_dir):
    """Matching blocks of each turn and the next; the blocks' order depends on their recursion, which SQL hasn't."""
    c = table(spark, sf_dir, "conversations")
    a, b = c.select("conv_id", "turn", F.col("text").alias("x")), c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("y"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", fuzzy.text_overlaps("x", "y", 8, tokenize=False).alias("overlaps"))


# Tf-idf


def corpus(spark, sf_dir, **options):
    return tfidf.Corpus(table(spark, sf_dir, "documents").select("doc_id", "text"), options=tfidf.Options(**options))


def _weights(spark, sf_dir, **options):
    return corpus(spark, sf_dir, **options).plan().select("doc_id", "term", "tf", *r6("weight"))


@query(f"with {weights()} select doc_id, term, tf, round(weight, 6) as weight from post")
def tfidf_weights(spark, sf_dir):
    return _weights(spark, sf_dir)


@query(f"with {weights(stop=True, bigrams=True)} select doc_id, term, tf, round(weight, 6) as weight from post")
def tfidf_ngrams(spark, sf_dir):
    return _weights(spark, sf_dir, stop_words=STOP, ngram_range=(1, 2))


@query(f"with {weights('df >= 5 and df <= 0.5 * (select n from n)')} select doc_id, term, tf, round(weight, 6) as weight from post")
def tfidf_min_max_df(spark, sf_dir):
    return _weights(spark, sf_dir, min_df=5, max_df=0.5)


@query(f"""with {weights()},
{post_of("(select 0 as item_id, text from benchmark where item_id = (select min(item_id) from benchmark))", "item_id", "q")},
s as (select doc_id, sum(weight * qw) as s from post join q on post.term = q.term group by doc_id)
select d.doc_id, d.text, round(coalesce(s, 0), 6) as search_cosine_similarity from documents d left join s on d.doc_id = s.doc_id""")
def search_corpus(spark, sf_dir):
    text = table(spark, sf_dir, "benchmark").orderBy("item_id").first()["text"]
    return tfidf.search(corpus(spark, sf_dir), text).select("doc_id", "text", *r6("search_cosine_similarity"))


@query(f"""with {weights()}, {post_of("benchmark", "item_id", "c")},
p as (select doc_id, item, sum(weight * qw) as similarity from post join c on post.term = c.term group by all having sum(weight * qw) >= 0.2 - 1e-12),
k as (select *, row_number() over (partition by doc_id order by round(similarity, 9) desc, item) as k from p)
select d.doc_id, k.item as match_id, b.text as match_text, round(similarity, 6) as similarity
from documents d left join k on d.doc_id = k.doc_id and k = 1 left join benchmark b on b.item_id = k.item""")
def match_list_multi(spark, sf_dir):
    out = tfidf.match_list(corpus(spark, sf_dir), table(spark, sf_dir, "benchmark"), "item_id", "text", allow_multiple=True, min_similarity=0.2)
    return out.select("doc_id", "match_id", "match_text", *r6("similarity"))


@query()
def match_list_exclusive(spark, sf_dir):
    out = tfidf.match_list(corpus(spark, sf_dir), table(spark, sf_dir, "benchmark"), "item_id", "text", min_similarity=0.2)
    return out.select("doc_id", "match_id", "match_text", *r6("similarity"))


# Similarity

_PAIRS = f"""{weights()},
pairs as (select a.doc_id as id_a, b.doc_id as id_b, sum(a.weight * b.weight) as sim from post a join post b on a.term = b.term and a.doc_id < b.doc_id group by all having sum(a.weight * b.weight) >= 0.9 - 1e-9)"""


@query(f"with {_PAIRS} select id_a, id_b, round(sim, 6) as sim from pairs")
def dup_pairs_cosine(spark, sf_dir):
    return similarity.cosine_pairs(corpus(spark, sf_dir), 0.9).select("id_a", "id_b", *r6("sim"))


@query(f"""with recursive {_PAIRS},
e as materialized (select id_a as u, id_b as v from pairs union select id_b, id_a from pairs),
reach as (select u, u as v from e union select r.u, e.v from reach r join e on r.v = e.u)
select min(v) as group_id, u as doc_id from reach group by u""")
def dup_groups_components(spark, sf_dir):
    return similarity.groups_of(materialise(similarity.cosine_pairs(corpus(spark, sf_dir), 0.9), "pairs"))


@query("select min(doc_id) over (partition by text) as group_id, doc_id, count(*) over (partition by text) as size from documents where text is not null qualify count(*) over (partition by text) > 1")
def dup_groups_exact(spark, sf_dir):
    return similarity.exact_groups(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def fuzzy_ratio_pairs(spark, sf_dir):
    return similarity.duplicate_pairs(corpus(spark, sf_dir)).select("id_a", "id_b", *r6("sim", "ratio"))


_PART = "(select p_partkey as doc_id, p_name || ' ' || p_type || ' ' || p_name || ' no' || p_size as text from part)"
_PART_PAIRS = f"""{weights(source="docs")},
near as (select a.doc_id as id_a, b.doc_id as id_b, sum(a.weight * b.weight) as sim from post a join post b on a.term = b.term and a.doc_id < b.doc_id group by all having sum(a.weight * b.weight) >= 0.8 - 1e-9),
texts as (select distinct x.text as a, y.text as b from near join docs x on x.doc_id = id_a join docs y on y.doc_id = id_b),
ratios as (select a, b, 200.0 * {_LCS.format(a='a', b='b')} / (length(a) + length(b)) as ratio from texts),
pairs as (select id_a, id_b, sim, ratio from near join docs x on x.doc_id = id_a join docs y on y.doc_id = id_b join ratios on ratios.a = x.text and ratios.b = y.text where ratio >= 90)"""


def _parts_corpus(spark, sf_dir):
    text = F.concat_ws(" ", "p_name", "p_type", "p_name", F.concat(F.lit("no"), F.col("p_size").cast("string")))
    return tfidf.Corpus(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text")))


@query(f"with docs as {_PART}, {_PART_PAIRS} select id_a, id_b, round(sim, 6) as sim, round(ratio, 6) as ratio from pairs")
def fuzzy_ratio_pairs_parts(spark, sf_dir):
    return similarity.duplicate_pairs(_parts_corpus(spark, sf_dir), 0.8).select("id_a", "id_b", *r6("sim", "ratio"))


@query(f"""with recursive docs as {_PART}, {_PART_PAIRS}, e as materialized (select id_a as u, id_b as v from pairs union select id_b, id_a from pairs),
reach as (select u, u as v from e union select r.u, e.v from reach r join e on r.v = e.u)
select min(v) as group_id, u as doc_id from reach group by u""")
def find_duplicates_parts(spark, sf_dir):
    return similarity.find_duplicates(_parts_corpus(spark, sf_dir), tfidf_threshold=0.8).select("group_id", "doc_id")


@query(f"""with docs as {_PART}, {_PART_PAIRS.replace("where ratio >= 90", "where ratio >= 90 and x.text[1] = y.text[1]")} select id_a, id_b, round(ratio, 6) as ratio from pairs""")
def find_duplicates_filtered(spark, sf_dir):
    """Pairs that a condition on both rows lets through."""
    same = lambda a, b: F.substring(f"{a}.text", 1, 1) == F.substring(f"{b}.text", 1, 1)
    return similarity.duplicate_pairs(_parts_corpus(spark, sf_dir), 0.8, filter_function=same, decode_text=True).select("id_a", "id_b", *r6("ratio"))


@query()
def find_duplicates(spark, sf_dir):
    return similarity.find_duplicates(corpus(spark, sf_dir)).select("group_id", "doc_id")


@query()
def overlap_fragments(spark, sf_dir):
    return similarity.corpus_fragments(corpus(spark, sf_dir))


@query(f"""with s as (select conv_id, turn, {_SENT.format(n=10)} as s from conversations)
select a.conv_id, a.turn as turn_a, b.turn as turn_b, cast(len(list_distinct(list_filter(a.s, lambda x: list_contains(b.s, x)))) as bigint) as shared from s a join s b on a.conv_id = b.conv_id and a.turn < b.turn""")
def text_overlaps_turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    a, b = c.select("conv_id", F.col("turn").alias("turn_a"), F.col("text").alias("x")), c.select("conv_id", F.col("turn").alias("turn_b"), F.col("text").alias("y"))
    return a.join(b, "conv_id").filter("turn_a < turn_b").select("conv_id", "turn_a", "turn_b", F.size(fuzzy.text_overlaps("x", "y", 10)).cast("long").alias("shared"))


# Pointwise mutual information


def _pmi_sql(sums: str, normalize: bool = True, smooth: float = 0.0, keep: str = "term") -> str:
    """The fifteen columns over (term, t, y1, y0, x1, a, b)."""

    def mi(j: str, side: str) -> str:
        ratio = f"(({j} / t) / nullif((x1 / t) * ({side} / t), 0) + {smooth})"
        value = f"case when {ratio} > 0 then log2({ratio}) when {ratio} is not null then 0.0 end"
        return f"({value}) / nullif(case when {j} / t > 0 then -log2({j} / t) end, 0)" if normalize else value

    ratio = "(a / nullif(y1, 0)) / nullif(b / nullif(y0, 0), 0)"
    columns = {
        "MI1": mi("a", "y1"), "MI0": mi("b", "y0"), "total": "x1", "total_pos_with_term": "a", "total_neg_with_term": "b", "total_pos_neg_with_term_diff": "a - b", "pct_with_term": "x1 / nullif(t, 0)",
        "pct_pos_with_term": "a / nullif(y1, 0)", "pct_neg_with_term": "b / nullif(y0, 0)", "pct_pos_neg_with_term_diff": "a / nullif(y1, 0) - b / nullif(y0, 0)", "pct_pos_neg_with_term_ratio": ratio,
        "pct_term_pos": "a / nullif(x1, 0)", "pct_term_neg": "b / nullif(x1, 0)", "pct_term_pos_neg_diff": "a / nullif(x1, 0) - b / nullif(x1, 0)", "pct_term_pos_neg_ratio": "a / nullif(b, 0)",
    }
    return f"select {keep}, " + ", ".join(f"{v} as {k}" for k, v in columns.items()) + f" from {sums}"


def _rounded(sql: str, keep: str = "term") -> str:
    return f"select {keep}, " + ", ".join(f"round({c}, 6) as {c}" for c in pmi.METRICS) + f" from ({sql})"


def _pmi_ctes(weight: str = "1.0", presence: bool = True) -> str:
    x = "1.0" if presence else "weight"
    return f"""{weights('df >= 5')},
o as (select doc_id, quality as y, cast({weight} as double) as w from labels join documents using (doc_id) where quality is not null),
tot as (select sum(w) as t, coalesce(sum(case when y = 1 then w end), 0) as y1, coalesce(sum(case when y = 0 then w end), 0) as y0 from o),
s as (select term, sum(w * {x}) as x1, sum(case when y = 1 then w * {x} else 0 end) as a, sum(case when y = 0 then w * {x} else 0 end) as b from post join o using (doc_id) group by term),
sums as (select * from s, tot)"""


def _labelled(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), table(spark, sf_dir, "labels")
    return tfidf.Corpus(docs.join(labels, "doc_id", "left"), options=tfidf.Options(min_df=5))


def _pmi(spark, sf_dir, **options):
    mi = pmi.corpus_mutual_info(_labelled(spark, sf_dir), "quality", binary=True, **options)
    return mi.select("term", *r6(*pmi.METRICS))


@query(f"with {_pmi_ctes()} {_rounded(_pmi_sql('sums'))}")
def pmi_quality(spark, sf_dir):
    return _pmi(spark, sf_dir)


@query(f"with {_pmi_ctes('n_chars')} {_rounded(_pmi_sql('sums'))}")
def pmi_weighted(spark, sf_dir):
    return _pmi(spark, sf_dir, weight_col="n_chars")


@query(f"with {_pmi_ctes()} {_rounded(_pmi_sql('sums', normalize=False))}")
def pmi_unnormalized(spark, sf_dir):
    return _pmi(spark, sf_dir, normalize=False)


@query(f"with {_pmi_ctes()} {_rounded(_pmi_sql('sums', smooth=1.0))}")
def pmi_smoothed(spark, sf_dir):
    return _pmi(spark, sf_dir, l=1.0)


@query(f"""with {weights('df >= 5')},
o as (select doc_id, cast(regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_])idiot($|[^\\p{{L}}\\p{{N}}_])') as int) as y from documents where text is not null),
tot as (select count(*)::double as t, sum(y)::double as y1, sum(1 - y)::double as y0 from o),
s as (select term, sum(weight) as x1, sum(case when y = 1 then weight else 0 end) as a, sum(case when y = 0 then weight else 0 end) as b from post join o using (doc_id) group by term),
m as ({_pmi_sql('(select * from s, tot)')})
select term, round(MI1, 6) as MI1 from m where round(MI1, 9) > 0 order by round(MI1, 9) desc, term limit 25""")
def related_keywords(spark, sf_dir):
    return pmi.related_keywords(corpus(spark, sf_dir, min_df=5), "idiot").select("term", *r6("MI1"))


@query(f"""with {weights('df >= 5')},
c as (select doc_id, lang as cluster from documents where text is not null and lang is not null),
y as (select cluster, count(*)::double as y1 from c group by cluster), t as (select sum(y1) as t from y),
i as (select cluster, term, count(*)::double as a from post join c using (doc_id) group by all), x as (select term, sum(a) as x1 from i group by term),
sums as (select cluster, term, t, y1, t - y1 as y0, x1, a, x1 - a as b from i join x using (term) join y using (cluster), t where y1 >= 50),
m as ({_pmi_sql('sums', keep='cluster, term')}),
k as (select *, row_number() over (partition by cluster order by round(MI1, 9) desc, term) as rank from m)
select cluster, rank, term, round(MI1, 6) as MI1 from k where rank <= 10 and round(MI1, 9) > 0""")
def cluster_terms(spark, sf_dir):
    cl = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.col("lang").alias("cluster"))
    return pmi.cluster_terms(corpus(spark, sf_dir, min_df=5), cl, 50, 10, binary=True).select("cluster", F.col("rank").cast("long").alias("rank"), "term", *r6("MI1"))


_TOP50 = f"m as ({_pmi_sql('sums')}), top as (select * from m where MI1 is not null order by round(MI1, 9) desc, term limit 50)"


@query(f"with {_pmi_ctes()}, {_TOP50} select term, round(MI1, 6) as MI1, round(pct_term_pos_neg_ratio, 6) as pct_term_pos_neg_ratio from top")
def mi_bar_table(spark, sf_dir):
    return pmi.bar_table(pmi.corpus_mutual_info(_labelled(spark, sf_dir), "quality", binary=True)).select("term", *r6("MI1", "pct_term_pos_neg_ratio"))


@query(f"""with {_pmi_ctes()}, {_TOP50}
select term, cast(row_number() over (order by round(pct_term_pos_neg_ratio, 9) asc nulls first, term) as double) as x, cast(row_number() over (order by round(MI1, 9) asc nulls first, term) as double) as y,
round((pct_pos_with_term - min(pct_pos_with_term) over ()) / nullif(max(pct_pos_with_term) over () - min(pct_pos_with_term) over (), 0), 6) as size,
round((MI1 - min(MI1) over ()) / nullif(max(MI1) over () - min(MI1) over (), 0), 6) as color from top""")
def mi_scatter_table(spark, sf_dir):
    return pmi.scatter_table(pmi.corpus_mutual_info(_labelled(spark, sf_dir), "quality", binary=True)).select("term", "x", "y", *r6("size", "color"))


# Co-occurrence

_COOC = f"""{tok(stop=True)}, t as (select distinct doc_id, term from tok), n as (select count(*) as n from documents where text is not null),
v as (select term, count(*) as df from t group by term having count(*) >= 10 and count(*) <= 0.5 * (select n from n)), k as (select t.* from t semi join v on t.term = v.term)"""


@query(f"with {_COOC} select a.term as a, b.term as b, count(*) as n from k a join k b on a.doc_id = b.doc_id and a.term <> b.term group by all")
def word_cooccurrence(spark, sf_dir):
    return cooccurrence.word_cooccurrence(table(spark, sf_dir, "documents"))


@query(f"with {_COOC} select a.term as a, b.term as b, round(count(*) / any_value(v.df)::double, 6) as n from k a join k b on a.doc_id = b.doc_id and a.term <> b.term join v on v.term = a.term group by all")
def word_cooccurrence_norm(spark, sf_dir):
    return cooccurrence.word_cooccurrence(table(spark, sf_dir, "documents"), normalize=True).select("a", "b", *r6("n"))


@query(f"with {tok('benchmark', 'item_id', stop=True)}, t as (select distinct doc_id, term from tok) select a.doc_id as a, b.doc_id as b, count(*) as n from t a join t b on a.term = b.term and a.doc_id <> b.doc_id group by all")
def doc_cooccurrence(spark, sf_dir):
    return cooccurrence.document_cooccurrence(table(spark, sf_dir, "benchmark"), "item_id")


# Sampling

_KEY = "md5('7|' || cast(c_custkey as varchar))"
_SYS = """sys as (select c_custkey, row_number() over (order by c_mktsegment, {key}, c_custkey) - 1 as at from {src}), sz as (select count(*)::double as n from {src}),
spots as (select distinct least(cast(round_even(0.25 + i * (n / {n}), 0) as bigint), cast(n as bigint) - 1) as at from range({n}) t(i), sz), picked as (select c_custkey from sys semi join spots on sys.at = spots.at)"""


def _sample(spark, sf_dir, n, strategy, by=None):
    return sampling.extract(table(spark, sf_dir, "customer"), "c_custkey", n, strategy, by, seed=7, start=0.25)


@query("select c_custkey from customer")
def sample_all(spark, sf_dir):
    return _sample(spark, sf_dir, 1, "all")


@query(f"select c_custkey from customer order by {_KEY}, c_custkey limit (select cast(round_even(count(*) * 0.1, 0) as bigint) from customer)")
def sample_random(spark, sf_dir):
    return _sample(spark, sf_dir, 0.1, "random")


@query(f"with {_SYS.format(key=_KEY, src='customer', n=100)} select c_custkey from picked")
def sample_stratified(spark, sf_dir):
    return _sample(spark, sf_dir, 100, "stratify", "c_mktsegment")


@query(f"""with k as (select *, row_number() over (partition by c_mktsegment order by {_KEY}, c_custkey) as k from customer), q as (select 103 // count(distinct c_mktsegment) as q from customer),
one as (select c_custkey from k, q where k <= q), rest as (select c_custkey from k, q where k > q order by {_KEY}, c_custkey limit (select 103 - count(*) from one))
select * from one union all select * from rest""")
def sample_even(spark, sf_dir):
    return _sample(spark, sf_dir, 103, "stratify_even", ["c_mktsegment"])


@query(f"""with k as (select *, row_number() over (partition by c_mktsegment order by {_KEY}, c_custkey) as k from customer), one as (select c_custkey from k where k = 1), rest as (select * from customer anti join one using (c_custkey)),
{_SYS.format(key=_KEY, src="rest", n="(select 60 - count(*) from one)")} select c_custkey from one union all select c_custkey from picked""")
def sample_guaranteed(spark, sf_dir):
    return _sample(spark, sf_dir, 60, "stratify_guaranteed", ["c_mktsegment"])


def _us(df):
    return df.select("o_orderkey", "o_orderstatus", "o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("f"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("u"), "o_totalprice")


_ORDERS = "o as (select *, (o_orderstatus = 'F')::int as f, (o_orderpriority = '1-URGENT')::int as u from orders), smp as (select * from o where o_totalprice > 150000)"


@query(f"""with {_ORDERS}, a as (select o_orderstatus, o_orderpriority, count(*)::double / (select count(*) from o) as x from o group by all),
b as (select o_orderstatus, o_orderpriority, count(*)::double / (select count(*) from smp) as y from smp group by all)
select o_orderkey, round(x / y, 6) as weight from smp join b using (o_orderstatus, o_orderpriority) left join a using (o_orderstatus, o_orderpriority)""")
def weights_from_frame(spark, sf_dir):
    frame = _us(table(spark, sf_dir, "orders"))
    return sampling.weights_from_frame(frame, frame.filter("o_totalprice > 150000"), ["o_orderstatus", "o_orderpriority"]).select("o_orderkey", *r6("weight"))


_BALANCED = "select o_orderkey, round((1.0 / k) / (n / t), 6) as weight from smp join (select f, u, {n} as n, sum({n}) over () as t, count(*) over () as k from smp group by f, u) c using (f, u)"


@query(f"with {_ORDERS} " + _BALANCED.format(n="count(*)::double"))
def weights_balanced(spark, sf_dir):
    return sampling.balanced_weights(_us(table(spark, sf_dir, "orders")).filter("o_totalprice > 150000"), ["f", "u"]).select("o_orderkey", *r6("weight"))


@query(f"with {_ORDERS} " + _BALANCED.format(n="sum(o_totalprice)"))
def weights_balanced_weighted(spark, sf_dir):
    return sampling.balanced_weights(_us(table(spark, sf_dir, "orders")).filter("o_totalprice > 150000"), ["f", "u"], "o_totalprice").select("o_orderkey", *r6("weight"))


# Inter-rater reliability


def _coders(spark, sf_dir):
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    each = F.explode(F.array(F.struct(F.lit("label").alias("coder"), F.col("quality").cast("int").alias("code"), F.col("toxic").alias("other")), F.struct(F.lit("length").alias("coder"), (F.col("n_chars") > 400).cast("int").alias("code"), (F.col("n_chars") > 5000).cast("int").alias("other"))))
    return both.select("doc_id", F.col("n_chars").cast("double").alias("w"), each.alias("c")).select("doc_id", "w", "c.coder", "c.code", "c.other")


_CODES = "c as (select doc_id, n_chars::double as w, quality as t, (n_chars > 400)::int as p from labels join documents using (doc_id))"


@query(f"""with {_CODES}, m as (select sum(w) as n, sum(w * t * p) as tp, sum(w * (1 - t) * (1 - p)) as tn, sum(w * (1 - t) * p) as fp, sum(w * t * (1 - p)) as fn, count(*) as k, sum((t = p)::int)::double as agree, sum(t)::double as t1, sum(p)::double as p1 from c),
d as (select *, (tp + tn) / n as acc, ((tp + fp) * (tp + fn) + (tn + fp) * (tn + fn)) / (n * n) as pe, tp / (tp + fp) as pr, tp / (tp + fn) as re, (tp + fn) / n as tm, (tp + fp) / n as pm, t1 / k as tu, p1 / k as pu from m),
u as (select 2.0 * k as n2, 2 * (k - agree) as o2, (t1 + p1) * (t1 + p1) + (2 * k - t1 - p1) * (2 * k - t1 - p1) as k2 from m)
select k as n, round(acc, 6) as accuracy, round((acc - pe) / (1 - pe), 6) as cohens_kappa, round(2 * pr * re / (pr + re), 6) as f1, round(pr, 6) as precision, round(re, 6) as recall, round(least(pr, re), 6) as precision_recall_min,
round((tp * tn - fp * fn) / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)), 6) as matthews_corrcoef, round((re + tn / (tn + fp)) / 2, 6) as roc_auc, round(agree / k, 6) as pct_agree_unweighted,
round(tm, 6) as coder1_mean, round(pm, 6) as coder2_mean, round(sqrt(tm * (1 - tm)) / sqrt(n - 1), 6) as coder1_std, round(sqrt(pm * (1 - pm)) / sqrt(n - 1), 6) as coder2_std,
round(tu, 6) as coder1_mean_unweighted, round(pu, 6) as coder2_mean_unweighted, round(sqrt(tu * (1 - tu)) / sqrt(k - 1), 6) as coder1_std_unweighted, round(sqrt(pu * (1 - pu)) / sqrt(k - 1), 6) as coder2_std_unweighted,
round(1 - (o2 / n2) / ((n2 * n2 - k2) / (n2 * (n2 - 1))), 6) as alpha_unweighted, 'label' as coder1, 'length' as coder2, 'code' as outcome_column, '1' as pos_label from d, u""")
def irr_pair_scores(spark, sf_dir):
    s = irr.scores(_coders(spark, sf_dir), "label", "length", "code", "doc_id", "coder", "w", pos_label=1)
    words = {"n", "coder1", "coder2", "outcome_column", "pos_label"}
    return s.select(*words, *r6(*[c for c in s.columns if c not in words]))


_GRADES = "g as (select quality + toxic as t, (n_chars > 400)::int + (n_chars > 5000)::int as p from labels join documents using (doc_id) where quality is not null and toxic is not null)"


@query(f"""with {_GRADES}, n as (select count(*)::double as n, sum((t = p)::int)::double as agree from g), l as (select distinct v from (select t as v from g union all select p from g)),
s as (select v, (select count(*) from g where t = v)::double as t, (select count(*) from g where p = v)::double as p, (select count(*) from g where t = v and p = v)::double as hit from l),
e as (select *, case when p > 0 then hit / p else 0 end as pr, case when t > 0 then hit / t else 0 end as re from s),
f as (select *, case when pr + re > 0 then 2 * pr * re / (pr + re) else 0 end as f1 from e)
select cast(n as bigint) as n, round(agree / n, 6) as accuracy, round(sum(t * f1) / n, 6) as f1, round(sum(t * pr) / n, 6) as precision, round(sum(t * re) / n, 6) as recall,
round((agree * n - sum(t * p)) / sqrt((n * n - sum(p * p)) * (n * n - sum(t * t))), 6) as matthews_corrcoef, round(agree / n, 6) as pct_agree_unweighted from f, n group by n, agree""")
def irr_pair_scores_multiclass(spark, sf_dir):
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").filter("quality is not null and toxic is not null")
    each = F.explode(F.array(F.struct(F.lit("label").alias("coder"), (F.col("quality") + F.col("toxic")).cast("int").alias("code")), F.struct(F.lit("length").alias("coder"), ((F.col("n_chars") > 400).cast("int") + (F.col("n_chars") > 5000).cast("int")).alias("code"))))
    s = irr.scores(both.select("doc_id", each.alias("c")).select("doc_id", "c.*"), "label", "length", "code", "doc_id", "coder")
    return s.select("n", *r6("accuracy", "f1", "precision", "recall", "matthews_corrcoef", "pct_agree_unweighted"))


_UNITS = f"{_CODES}, l as (select t as a, p as b from c), n as (select 2.0 * count(*) as n, sum((a <> b)::int) * 2.0 as o from l), k as (select v, count(*)::double as k from (select a as v from l union all select b from l) group by v), q as (select sum(k * k) as k2 from k)"


@query(f"with {_UNITS} select round(1 - (o / n) / ((n * n - k2) / (n * (n - 1))), 6) as alpha from n, q")
def irr_overall_alpha(spark, sf_dir):
    return irr.overall_scores(_coders(spark, sf_dir), "code", "doc_id", "coder").select(*r6("alpha"))


@query(f"with {_UNITS} select round(((1 - o / n) - k2 / (n * n)) / (1 - k2 / (n * n)), 6) as fleiss_kappa from n, q")
def irr_fleiss(spark, sf_dir):
    return irr.overall_scores(_coders(spark, sf_dir), "code", "doc_id", "coder").select(*r6("fleiss_kappa"))


@query(f"""with l as (select quality as c1, toxic as o1, (n_chars > 400)::int as c2, (n_chars > 5000)::int as o2 from labels join documents using (doc_id)),
s as (select 'a' || c1 || o1 as x, 'a' || c2 || o2 as y from l), k as (select 2.0 * count(*) as n from s),
v as (select s, count(*)::double as k from (select x as s from s union all select y from s) group by s),
pairs as (select x, y, 1.0 as w, 'o' as side from s union all select a.s, b.s, a.k * b.k - case when a.s = b.s then a.k else 0 end, 'e' from v a join v b on true),
d as (select *, (x[2] = y[2])::int + (x[3] = y[3])::int as ov from pairs),
z as (select side, sum(w * case when ov = 2 then 0 else 1 end) as discrete, sum(w * case ov when 2 then 0 when 1 then 2.0 / 3 else 1 end) as jaccard, sum(w * case ov when 2 then 0 when 1 then 1 - 0.33 / 3 else 1 end) as masi, sum(w * (1 - ov / 2.0)) as cosine from d group by side),
e as (select sum(p.k * q.k) / (select count(*) * count(*) from s)::double as e from (select x, count(*)::double as k from s group by x) p join (select y, count(*)::double as k from s group by y) q on p.x = q.y),
f as (select sum(k * k) / ((select n * n from k)) as pe from v)
select {", ".join(f"round(1 - (2 * o.{d} / n) / (e.{d} / (n * (n - 1))), 6) as alpha_{d}, round(((1 - 2 * o.{d} / n) - e.e) / (1 - e.e), 6) as kappa_{d}" for d in ("discrete", "jaccard", "masi", "cosine"))},
round(((1 - 2 * o.discrete / n) - pe) / (1 - pe), 6) as fleiss_kappa_classic
from (select * from z where side = 'o') o, (select z.*, e.e from z, e where side = 'e') e, k, f""")
def irr_multivariate(spark, sf_dir):
    out = irr.overall_scores_multivariate(_coders(spark, sf_dir), "doc_id", "coder", ["code", "other"])
    return out.select(*r6(*out.columns))


@query("select * from (values ('power', 271), ('power_twosided', 349), ('ci', 140), ('ci_twosided', 197)) t(kind, n)")
def kappa_sample_sizes(spark, sf_dir):
    rows = [
        ("power", irr.kappa_sample_size_power(rate1=0.4, rate2=0.5, k1=0.8, k0=0.7)),
        ("power_twosided", irr.kappa_sample_size_power(rate1=0.4, rate2=0.5, k1=0.8, k0=0.7, twosided=True)),
        ("ci", irr.kappa_sample_size_ci(kappa0=0.8, kappaL=0.7, props=0.5)),
        ("ci_twosided", irr.kappa_sample_size_ci(kappa0=0.8, kappaL=0.7, props=0.5, kappaU=0.9)),
    ]
    return spark.createDataFrame(rows, "kind string, n int")


# Clusters, components, topics


def _vectors(spark, sf_dir):
    return clustering.array_features(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query()
def kmeans_embeddings(spark, sf_dir):
    return clustering.kmeans(_vectors(spark, sf_dir), 10, seed=1)


@query()
def hdbscan_embeddings(spark, sf_dir):
    return clustering.hdbscan(_vectors(spark, sf_dir), min_cluster_size=10)


@query()
def pca_embeddings(spark, sf_dir):
    return decomposition.pca(_vectors(spark, sf_dir), k=5).scores


@query()
def lsa_topdocs(spark, sf_dir):
    c = corpus(spark, sf_dir, stop_words=STOP, min_df=0.02, max_df=0.5)
    scores = decomposition.lsa(clustering.text_features(c), k=5).scores
    return decomposition.top_documents(scores, "lsa", 5)


@query()
def correspondence_lang_source(spark, sf_dir):
    edges = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("src"), F.col("lang").alias("dst")).agg(F.count("*").alias("w"))
    return decomposition.correspondence_analysis(edges, 2)


def _topics(spark, sf_dir, method, k=5, **params):
    """All parameters of the methods are their defaults, bigrams included; only the vocabulary is cut by frequency."""
    return topics.TopicModel(table(spark, sf_dir, "documents"), "doc_id", "text", method, k, min_df=0.02, max_df=0.5).fit(**params)


@query()
def lda_topics(spark, sf_dir):
    return _topics(spark, sf_dir, "lda").topics(10)


@query()
def lda_auto_topics(spark, sf_dir):
    return _topics(spark, sf_dir, "lda_auto").topics(10)


@query()
def hdp_topics(spark, sf_dir):
    return _topics(spark, sf_dir, "hdp", None).topics(10)


@query()
def nmf_topics(spark, sf_dir):
    return _topics(spark, sf_dir, "nmf").topics(10)


@query()
def corex_topics(spark, sf_dir):
    return _topics(spark, sf_dir, "corex").topics(10)


@query()
def corex_score(spark, sf_dir):
    score = _topics(spark, sf_dir, "corex", anchors=["the", "und"]).get_score()
    return spark.createDataFrame(list(score.items()), "name string, value double")


@query()
def nmf_document_topics(spark, sf_dir):
    return _topics(spark, sf_dir, "nmf").document_topics(table(spark, sf_dir, "documents"))


def _text_features(spark, sf_dir):
    return clustering.text_features(corpus(spark, sf_dir, stop_words=STOP, min_df=0.02, max_df=0.5))


@query()
def kmeans_texts(spark, sf_dir):
    return clustering.kmeans(_text_features(spark, sf_dir), 10, seed=1)


@query()
def hdbscan_texts(spark, sf_dir):
    return clustering.hdbscan(_text_features(spark, sf_dir), min_cluster_size=10)


@query()
def pca_texts(spark, sf_dir):
    return decomposition.pca(_text_features(spark, sf_dir), k=5).scores


# Dates, entities, words


@query("""with d as (select o_orderkey, 0 as k, date_trunc('day', o_orderdate) as ts, strftime(o_orderdate, '%B %-d, %Y') as raw from orders
union all select o_orderkey, 1, date_trunc('day', o_orderdate) + interval 40 day, strftime(o_orderdate + interval 40 day, '%m/%d/%Y') from orders)
select o_orderkey, ts, raw from d where ts >= date '1995-03-01' and ts < date '1997-01-01'""")
def date_finder(spark, sf_dir):
    a, b = F.date_format("o_orderdate", "MMMM d, yyyy"), F.date_format(F.date_add("o_orderdate", 40), "MM/dd/yyyy")
    text = F.concat(F.lit("Sold on "), a, F.lit(" at 10:30 to you; due "), b, F.lit(", or by "), a, F.lit(". Call 12 to 15 people."))
    o = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return dates.dates_table(o, "o_orderkey", "text", cutoff_start="1995-03-01", cutoff_end="1996-12-31").withColumnRenamed("doc_id", "o_orderkey")


_LEXICON_SQL = f"lex as (select w as word, case when right(w, 1) = 'n' then 'NN' when right(w, 1) = 'e' then 'JJ' else 'VB' end as tag, case when length(w) > 4 and right(w, 1) = 's' then w[:-2] else w end as lemma from (select distinct unnest(regexp_extract_all(lower(text), '{_TOKEN}')) as w from benchmark))"
_TAGGED = f"wd as (select doc_id, unnest(w) as word, unnest(range(len(w))) as position from (select doc_id, regexp_extract_all(text, '{_TOKEN}') as w from documents where text is not null)), tg as (select wd.*, tag, coalesce(lemma, lower(wd.word)) as lemma from wd left join lex on lower(wd.word) = lex.word)"


def _lexicon(spark, sf_dir):
    """A lexicon for want of one: the benchmark's words, tagged by their ends."""
    w = table(spark, sf_dir, "benchmark").select(F.explode(tx.tokens("text")).alias("word")).distinct()
    tag = F.when(F.right("word", F.lit(1)) == "n", "NN").when(F.right("word", F.lit(1)) == "e", "JJ").otherwise("VB")
    lemma = F.when((F.length("word") > 4) & (F.right("word", F.lit(1)) == "s"), F.expr("left(word, length(word) - 1)")).otherwise(F.col("word"))
    return w.select("word", tag.alias("tag"), lemma.alias("lemma"))


@query(f"with {_LEXICON_SQL}, {_TAGGED} select doc_id, string_agg(word, ' ' order by position) as text from tg where tag in ('NN', 'JJ', 'NNP') group by doc_id")
def pos_filter(spark, sf_dir):
    return language.filter_tags(table(spark, sf_dir, "documents"), "doc_id", "text", _lexicon(spark, sf_dir))


@query(f"with {_LEXICON_SQL}, {_TAGGED} select doc_id, string_agg(lemma, ' ' order by position) as text from tg group by doc_id")
def lemmatise(spark, sf_dir):
    return language.lemmatise(table(spark, sf_dir, "documents"), "doc_id", "text", _lexicon(spark, sf_dir))


@query()
def pos_filter_rules(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", language.filter_parts_of_speech("text").alias("text"))


_FAMOUS = r"'[A-Z][a-z]{4,}(?: [a-z]{4,})?'"


@query(rf"""with g as (select name, case when name < 'M' then 'PERSON' else 'LOCATION' end as kind from (select distinct unnest(regexp_extract_all(text, {_FAMOUS})) as name from benchmark)),
w as (select doc_id, regexp_extract_all(text, '{_TOKEN}') as w from documents where text is not null),
r as (select distinct doc_id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) as name from w)
select kind, r.name, count(*) as n from r join g on r.name = g.name group by kind, r.name""")
def ner_counts(spark, sf_dir):
    """Names of a table, here capitalised words of the benchmark with and without the next, by the texts they stand in."""
    found = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(_FAMOUS.strip("'")), F.lit(0))).alias("name")).distinct()
    names = found.withColumn("kind", F.when(F.col("name") < "M", "PERSON").otherwise("LOCATION"))
    hits = language.entities_by_table(table(spark, sf_dir, "documents"), "doc_id", "text", names)
    return hits.groupBy("kind", "name").agg(F.count("*").alias("n"))


@query()
def ner_rules(spark, sf_dir):
    """Entities told by the shape of words, as a stand-in for a model."""
    found = table(spark, sf_dir, "documents").select(F.explode(language.named_entities("text")).alias("kind", "names"))
    return found.groupBy("kind").agg(F.sum(F.size("names")).cast("long").alias("n"))


#: Senses, least depth and largest lemma count of some words.
_SENSES = [("the", 0, None, None), ("and", 0, None, None), ("mit", 1, 6, 1), ("ein", 2, 7, 0), ("que", 2, 5, 2), ("dans", 3, 4, 9), ("for", 2, 4, 1), ("with", 5, 2, 30), ("los", 4, 6, 1), ("une", 4, 3, 1), ("pour", 6, 2, 12), ("sich", 2, 3, 8), ("nicht", 9, 9, 40), ("para", 2, 9, 3)]


@query(f"""with lex(word, n, depth, lemma) as (values {", ".join(f"('{w}', {n}, {'null' if d is None else d}, {'null' if m is None else m})" for w, n, d, m in _SENSES)}),
t as (select distinct unnest(regexp_extract_all(lower(text), '{_TOKEN}')) as term from documents)
select term, coalesce(n, 0) <= 1 or ((n < 3)::int + coalesce((depth >= 5)::int, 0) + coalesce((lemma <= 2)::int, 0)) > 1 as is_stopword from t left join lex on term = word""")
def stopword_detector(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(tx.tokens("text")).alias("term")).distinct()
    lexicon = spark.createDataFrame(_SENSES, "word string, n_synsets int, min_depth int, max_lemma int")
    return language.probable_stopwords(words, lexicon, "term")
