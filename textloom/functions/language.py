"""Stemming, part-of-speech tags, named entities and the stop word detector.

Trained models and lexicons are not shipped: each takes one from the caller and has a rule-based stand-in.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import ngrams, tokens

_V = "aeiouy"


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in _V and w[i - 1] in _V:
                return i + 1
        return len(w)

    for p in ("gener", "commun", "arsen"):
        if w.startswith(p):
            r1 = len(p)
            break
    else:
        r1 = after(0)
    return r1, after(r1) if r1 < len(w) else len(w)


_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
_KEEP = set("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", "")]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def stem(word: str) -> str:
    """The English Snowball stem (Porter2)."""
    w = word.lower()
    if len(w) <= 2:
        return w
    if w in _SPECIAL:
        return _SPECIAL[w]
    w = w.lstrip("'")
    if w.startswith("y"):
        w = "Y" + w[1:]
    w = re.sub(f"(?<=[{_V}])y", "Y", w)
    r1, r2 = _regions(w)

    def short(x: str) -> bool:
        return bool(re.search(f"[^{_V}][{_V}][^{_V}wxY]$", x) or re.fullmatch(f"[{_V}][^{_V}]", x))

    w = re.sub(r"('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}]", w[:-2]):
        w = w[:-1]
    if w in _KEEP:
        return w
    m = re.search("(eedly|eed)$", w)
    if m:
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    else:
        m = re.search("(ingly|edly|ing|ed)$", w)
        if m and re.search(f"[{_V}]", w[: m.start()]):
            w = w[: m.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
                w = w[:-1]
            elif r1 >= len(w) and short(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for s, by in _STEP2:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r1 and not (s == "ogi" and w[at - 1 : at] != "l") and not (s == "li" and w[at - 1 : at] not in tuple("cdeghkmnrt")):
                w = w[:at] + by
            break
    for s, by in _STEP3:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= (r2 if s == "ative" else r1):
                w = w[:at] + by
            break
    for s in _STEP4:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r2 and not (s == "ion" and w[at - 1 : at] not in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not short(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stem_words(words: Column) -> Column:
    """Stems of an array of words; each different word of a batch is stemmed once."""

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        known: dict[str, str] = {}

        def of(w: str) -> str:
            if w not in known:
                known[w] = stem(w)
            return known[w]

        return pd.Series([None if x is None else [of(w) for w in x] for x in lists])

    return run(words)


_CLOSED = {"the": "DT", "a": "DT", "an": "DT", "this": "DT", "that": "DT", "and": "CC", "or": "CC", "but": "CC", "of": "IN", "in": "IN", "on": "IN", "at": "IN", "by": "IN", "with": "IN", "from": "IN", "for": "IN", "to": "TO", "i": "PRP", "you": "PRP", "he": "PRP", "she": "PRP", "it": "PRP", "we": "PRP", "they": "PRP", "my": "PRP$", "his": "PRP$", "her": "PRP$", "their": "PRP$", "is": "VBZ", "are": "VBP", "was": "VBD", "were": "VBD", "be": "VB", "been": "VBN", "has": "VBZ", "have": "VBP", "had": "VBD", "do": "VBP", "does": "VBZ", "did": "VBD", "will": "MD", "would": "MD", "can": "MD", "could": "MD", "may": "MD", "should": "MD", "not": "RB", "very": "RB", "who": "WP", "what": "WP", "which": "WDT", "when": "WRB", "where": "WRB", "there": "EX"}
_SUFFIX_TAGS = [("ly", "RB"), ("ing", "VBG"), ("ed", "VBD"), ("ous", "JJ"), ("ful", "JJ"), ("ive", "JJ"), ("able", "JJ"), ("ible", "JJ"), ("al", "JJ"), ("ic", "JJ"), ("est", "JJS"), ("s", "NNS")]


def tag_word(word: str, first: bool = False) -> str:
    """Penn tag by a small lexicon, shape and suffix."""
    bare = word.strip(".,;:!?\"'()")
    low = bare.lower()
    if low in _CLOSED:
        return _CLOSED[low]
    if bare and (bare[0].isdigit()):
        return "CD"
    if bare[:1].isupper() and not first:
        return "NNP"
    return next((t for s, t in _SUFFIX_TAGS if low.endswith(s) and len(low) > len(s) + 2), "NN")


def filter_parts_of_speech(text: Column | str, filter_pos: list[str] | None = None, exclude: bool = False, tagger: Callable[[list[str]], list[str]] | None = None) -> Column:
    """The words with these tags (or without them), joined by a space; nouns, names and adjectives by default."""
    tags = set(filter_pos or ["NN", "NNP", "JJ"])
    tag = tagger or (lambda words: [tag_word(w, i == 0) for i, w in enumerate(words)])

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            words = (t or "").split()
            out.append(None if t is None else " ".join(w for w, k in zip(words, tag(words)) if (k in tags) != exclude))
        return pd.Series(out)

    return run(text)


def tagged_words(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame) -> DataFrame:
    """(doc_id, position, word, tag, lemma) of all words, from a lexicon of (word, tag, lemma).

    Words are looked up in lower case; one that the lexicon lacks has a null tag and is its own lemma. A join on the
    word: Spark sends a small lexicon to the workers and shuffles by a large one. A word that the lexicon has more
    than once takes its smallest tag, with that row's lemma.
    """
    first = lexicon.groupBy(F.lower("word").alias("w")).agg(F.min(F.struct("tag", "lemma")).alias("e"))
    words = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.posexplode(tokens(text_col, False)).alias("position", "word"))
    return words.join(first, F.lower("word") == F.col("w"), "left").select("doc_id", "position", "word", F.col("e.tag").alias("tag"), F.coalesce("e.lemma", F.lower("word")).alias("lemma"))


def _in_order(words: DataFrame, column: str) -> DataFrame:
    lists = words.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", F.col(column).alias("x")))).alias("v"))
    return lists.select("doc_id", F.array_join(F.transform("v", lambda p: p["x"]), " ").alias("text"))


def filter_tags(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame, filter_pos: list[str] | None = None, exclude: bool = False) -> DataFrame:
    """(doc_id, text): the words with these tags of the lexicon (or without them), in order; texts left with none are not listed."""
    hit = F.coalesce(F.col("tag").isin(filter_pos or ["NN", "NNP", "JJ"]), F.lit(False))
    return _in_order(tagged_words(df, id_col, text_col, lexicon).filter(~hit if exclude else hit), "word")


def lemmatise(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame) -> DataFrame:
    """(doc_id, text): every word by its lemma, in order."""
    return _in_order(tagged_words(df, id_col, text_col, lexicon), "lemma")


def entities_by_table(df: DataFrame, id_col: str, text_col: str, names: DataFrame, longest: int = 3) -> DataFrame:
    """(doc_id, kind, name) of the names of a table (name, kind) that stand in the texts, of up to ``longest`` words.

    Runs of words are looked up as they are written, by a join on the name; each name counts once a text.
    """
    words = tokens(text_col, False)
    runs = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.explode(F.array_distinct(ngrams(words, 1, longest))).alias("name"))
    return runs.join(names.select("name", "kind").distinct(), "name").select("doc_id", "kind", "name")


ENTITY_LABELS = dict(ORG="ORGANIZATION", PER="PERSON", LOC="LOCATION", FAC="FACILITY", VEH="VEHICLE", WEA="WEAPON", GSP="GPE")
_TITLES = {"mr", "mrs", "ms", "dr", "president", "senator", "judge", "general", "prof"}
_ORG = {"inc", "corp", "company", "university", "committee", "congress", "senate", "department", "party", "court", "union", "bank"}
_PLACE = {"city", "county", "river", "street", "island", "mountains", "states", "kingdom", "republic"}
_ENTITY_STOP = {"The", "A", "An", "This", "That", "These", "Those", "In", "On", "At", "It", "I", "We", "He", "She", "They", "But", "And", "Of", "For", "If", "As", "By"}


def _rule_entities(text: str) -> list[tuple[str, str]]:
    out = []
    for sentence in re.split(r"(?<=[.!?])\s+|\n", text):
        for m in re.finditer(r"(?<![\w.])[A-Z][\w'’-]*(?: (?:of |the )?[A-Z][\w'’-]*)*", sentence):
            words = m.group().split()
            if words and words[0] in _ENTITY_STOP:
                words = words[1:]
            if not words or (m.start() == 0 and len(words) < 2):
                continue
            low = {w.lower() for w in words}
            kind = "ORGANIZATION" if low & _ORG else "GPE" if low & _PLACE else "PERSON" if low & _TITLES or len(words) > 1 else "ENTITY"
            out.append((kind, " ".join(words)))
    return out


def named_entities(text: Column | str, methods: list[Callable[[str], list[tuple[str, str]]]] | None = None) -> Column:
    """map<type, array of different entities>, united over the methods; labels are brought to one set.

    Without methods runs of capitalised words stand in, typed by the words in them.
    """
    found = methods or [_rule_entities]

    @F.pandas_udf("array<struct<k:string,v:array<string>>>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            by: dict[str, set] = {}
            for extract in found if t is not None else []:
                for kind, name in extract(t):
                    by.setdefault(ENTITY_LABELS.get(kind, kind), set()).add(name)
            out.append(None if t is None else [{"k": k, "v": sorted(v)} for k, v in sorted(by.items())])
        return pd.Series(out)

    return F.map_from_entries(run(text))


def probable_stopwords(words: DataFrame, lexicon: DataFrame, word_col: str = "word") -> DataFrame:
    """``words`` with ``is_stopword``, from a lexicon of (word, n_synsets, min_depth, max_lemma).

    A word of at most one sense is one; another if more than one of these hold: under 3 senses, depth of 5 or more,
    lemma counts of at most 2. A join and an expression; words missing from the lexicon have no sense.
    """
    lex = lexicon.select(F.col("word").alias("__w"), "n_synsets", "min_depth", "max_lemma")
    score = (F.col("n_synsets") < 3).cast("int") + F.coalesce((F.col("min_depth") >= 5).cast("int"), F.lit(0)) + F.coalesce((F.col("max_lemma") <= 2).cast("int"), F.lit(0))
    joined = words.join(lex, F.lower(words[word_col]) == F.col("__w"), "left")
    return joined.select(words["*"], F.when(F.coalesce("n_synsets", F.lit(0)) <= 1, True).otherwise(score > 1).alias("is_stopword"))
