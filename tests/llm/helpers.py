"""Small tables with awkward rows, shared by the operators' tests."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(r, n):
    return " ".join(r.choice(WORDS) + r.choice(["", "", ",", "."]) for _ in range(n))


#: (doc_id, text): nulls, blanks, repeats, odd characters, one very long text.
AWKWARD = [(9001, None), (9002, ""), (9003, " \t\n "), (9004, "one"), (9005, "one two three"), (9006, "one two three"), (9007, "É́ naïve ... <|endoftext|> \U0001f600 İ"), (9008, "word " * 30_000)]


def frame(spark, rows, extra=True):
    """doc_id, text and, to clash with what operators add, columns named like their outputs."""
    if extra:
        return spark.createDataFrame([(i, t, "x", 0.5, "L") for i, t in rows], "doc_id long, text string, score string, threshold double, lang_pred string")
    return spark.createDataFrame(rows, "doc_id long, text string")
