"""Inputs with nulls, empty and very long texts, ties, repeated rows and clashing names."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango".split()


def sentence(k: int, n: int = 30) -> str:
    return " ".join(f"{WORDS[(k * 7 + i * (3 + k % 5)) % 20]}{(k * 31 + i * i) % 97}" for i in range(n))


def odd_docs(spark, extra: bool = False):
    rows = [
        (1, "First plain text. " + sentence(1), "en", "src0", 10),
        (1, "First plain text. " + sentence(1), "en", "src0", 10),
        (2, None, "en", "src0", None),
        (None, "Nobody knows the id of this text. " + sentence(2), None, None, 5),
        (None, None, None, None, None),
        (3, "", "de", "src1", 0),
        (4, " \n\t ", "de", "src1", 4),
        (5, "x", None, "src1", 1),
        (6, sentence(3, 30000), "fr", "src2", 9),
        (7, "###", "fr", None, 3),
        (8, "Ünïcödé 🙂 text, ½ and ² too.\x00 end", "de", "src2", 3),
    ]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        df = df.selectExpr("*", "'a' as token_ids", "1 as hash", "2 as key", "3 as node", "4 as row", "5 as piece", "6 as id", "7 as item_id", "8 as host", "9 as text_hash", "10 as `odd.name`")
    return df


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
