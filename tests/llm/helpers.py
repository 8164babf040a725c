"""Small tables with the hard cases every operator must survive."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, size string, digest string, _n int"


def hard_rows():
    base = " ".join(f"w{k}" for k in range(60))
    texts = [
        (1, base), (2, base), (2, base), (3, base.replace("w30", "W30")), (4, base.replace("w30", "other")),
        (5, None), (6, ""), (7, " \t\n "), (8, "one"), (9, "ONE"), (10, "two words"),
        (None, base), (None, None), (11, "x" * 50_000), (12, " ".join(f"v{k % 977}" for k in range(40_000))),
        (13, "a  b\n\nc"), (14, "a b c"), (15, "café 中文 \U0001f600 <|endoftext|> end"), (15, "same id, other text"),
    ]
    sources = ["s0", "s0", "s1", None, "", "s2"]
    return [(i, t, "en", sources[k % 6], 0, 0.5, True, "clash", "clash", 7) for k, (i, t) in enumerate(texts)]


def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
