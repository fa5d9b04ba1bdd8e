"""Column expressions over texts: tokens, cleaning, fragments and sentences. All of it stays in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and underscore of any script; `\\w` is ASCII only in Java.
TOKEN = r"[\p{L}\p{N}_]{2,}"
URL = r"(?i)\b(?:https?://|www\.)[^\s<>\"']+"
#: Applied in this order, each as a whole word.
CONTRACTIONS = [
    ("won't", "will_not"), ("can't", "cannot"), ("i'm", "i am"), ("ain't", "is not"), ("([a-z]+)'ll", "$1 will"), ("([a-z]+)n't", "$1_not"),
    ("([a-z]+)'ve", "$1 have"), ("([a-z]+)'re", "$1 are"), ("([a-z]+)'d", "$1 would"), ("it's", "it is"),
]

_ACCENTED = "".join(chr(c) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFKD", chr(c))[0].encode()) == 1 and unicodedata.normalize("NFKD", chr(c))[0].isalpha() and len(unicodedata.normalize("NFKD", chr(c))) == 2)
_PLAIN = "".join(unicodedata.normalize("NFKD", c)[0] for c in _ACCENTED)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


_STOP_WORDS = """
a about above after again against all am an and any are as at be because been before being below between both but by
can cannot could did do does doing down during each few for from further had has have having he her here hers herself
him himself his how i if in into is it its itself just me might more most must my myself no nor not now of off on once
only or other ought our ours ourselves out over own same shall she should so some such than that the their theirs them
themselves then there these they this those through to too under until up upon us very was we were what when where
which while who whom whose why will with within without would you your yours yourself yourselves
""".split()


def stopwords() -> list[str]:
    """English function words."""
    return list(_STOP_WORDS)


def fold(text: Column | str) -> Column:
    """Latin letters without their accents."""
    return F.translate(_col(text), _ACCENTED, _PLAIN)


def has_fragment(text: Column | str, fragment: Column | str) -> Column:
    """Whether the fragment stands in the text as it is, or both without accents do; null if either is null."""
    text, fragment = _col(text), _col(fragment)
    return F.contains(text, fragment) | F.contains(fold(text), fold(fragment))


def remove_fragments(text: Column | str, fragments: Column | list[str]) -> Column:
    """The text without the fragments, taken out one after another; a removal that would leave nothing is skipped.

    Where a fragment is only found without accents, the text without accents is what it is taken from.
    """
    text = _col(text)
    if isinstance(fragments, list):
        fragments = F.array(*[F.lit(f) for f in fragments])

    def step(t: Column, f: Column) -> Column:
        plain, folded = F.replace(t, f, F.lit("")), F.replace(fold(t), fold(f), F.lit(""))
        left = F.when(F.contains(t, f), plain).when(F.contains(fold(t), fold(f)), folded).otherwise(t)
        return F.when((left == "") | (f == ""), t).otherwise(left)

    return F.aggregate(fragments, text, step)


def strip_html(text: Column | str) -> Column:
    """Text without scripts, styles, comments and tags, and with the common entities put back."""
    t = F.regexp_replace(_col(text), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for entity, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(c))
    return F.trim(F.regexp_replace(t, r"[ \t\n\r\f]+", " "))


def expand_contractions(text: Column | str, replacers: list[tuple[str, str]] | None = None) -> Column:
    """Own replacers first, then the fixed rules; of each, whole words only."""
    t = _col(text)
    for pattern, by in [*(replacers or []), *CONTRACTIONS]:
        t = F.regexp_replace(t, rf"(?i)(?<![\p{{L}}\p{{N}}_]){pattern}(?![\p{{L}}\p{{N}}_])", by)
    return t


def tokens(text: Column | str, lowercase: bool = True) -> Column:
    text = _col(text)
    return F.regexp_extract_all(F.lower(text) if lowercase else text, F.lit(TOKEN), F.lit(0))


def ngrams(words: Column, low: int = 1, high: int = 1) -> Column:
    """All runs of ``low`` to ``high`` words, joined by a space."""

    def runs(n: int) -> Column:
        # words are no part of a lambda, which would work them out again for every run
        if n == 1:
            return words
        longer = F.zip_with(runs(n - 1), F.slice(words, F.lit(n), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.slice(longer, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))

    parts = [runs(n) for n in range(low, high + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def clean(
    text: Column | str,
    stop_words: list[str] | None = None,
    replacers: list[tuple[str, str]] | None = None,
    lowercase: bool = True,
    remove_urls: bool = True,
    html: bool = False,
    process: callable | None = None,
    filter_pos: callable | None = None,
    min_length: int = 3,
) -> Column:
    """The words worth keeping, joined by a space.

    Steps: markup, accents, part-of-speech filter (a Column function), case, addresses, contractions, stop words,
    other characters, the word processor (a Column function over the array of words, as a stemmer), words under
    three letters, stop words again, and words with digits. Stop words match in either case.
    """
    stop = {w.lower() for w in (stopwords() if stop_words is None else stop_words)}
    t = _col(text)
    t = strip_html(t) if html else t
    t = fold(t)
    t = filter_pos(t) if filter_pos else t
    t = F.lower(t) if lowercase else t
    t = F.regexp_replace(t, URL, " ") if remove_urls else t
    t = expand_contractions(t, replacers)
    words = F.split(F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}_']+", " ")), " ")
    keep = (lambda w: ~F.lower(w).isin(stop)) if stop else (lambda w: F.lit(True))
    words = F.filter(words, keep)
    # apostrophes only held contractions together until here
    words = F.filter(F.split(F.regexp_replace(F.array_join(words, " "), "'", " "), " +"), lambda w: keep(w) & (w != ""))
    words = process(words) if process else words
    words = F.filter(words, lambda w: (F.length(w) >= min_length) & keep(w) & ~w.rlike("[0-9]"))
    return F.array_join(words, " ")


def sentences(text: Column | str, min_length: int | None = None, leading: str | None = None, trailing: str | None = None) -> Column:
    """Sentences without the white space around them; those under ``min_length`` characters are dropped.

    A sentence ends after . ! or ? before white space. ``leading`` cuts before each match of a pattern and
    ``trailing`` after it; the match is kept only if the pattern has a capture group.
    """
    parts = F.split(_col(text), r"(?<=[.!?])\s+")
    mark = "\x01"

    def cut(parts: Column, pattern: str, before: bool) -> Column:
        kept = "(" in pattern.replace("(?", "").replace("\\(", "")
        by = (f"{mark}$0" if before else f"$0{mark}") if kept else mark
        return F.flatten(F.transform(parts, lambda s: F.split(F.regexp_replace(s, pattern, by), mark)))

    if trailing:
        parts = cut(parts, trailing, False)
    if leading:
        parts = cut(parts, leading, True)
    parts = F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", "")))
    least = max(1, min_length or 1)
    return F.filter(parts, lambda s: F.length(s) >= least)
