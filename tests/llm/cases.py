"""Small tables for the operators: planted cases, odd rows, and none at all."""

import random

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: columns whose names the operators use inside
EXTRA = "start long, block string, fp string, score string, component_id string, kind string, part string"


def frame(spark, rows, extra=False):
    """documents from (doc_id, text) pairs, with clashing extra columns on demand."""
    full = [(i, t, "en", "src", None if t is None else len(t)) + ((None,) * 7 if extra else ()) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA + (", " + EXTRA if extra else ""))


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 8))) for _ in range(n))


def odd_rows():
    """Null and empty texts, null and repeated ids, repeated rows, odd characters, one long text."""
    return [(1, None), (2, ""), (3, "   \n\t "), (None, "no id here at all"), (None, None), (4, "same row twice"), (4, "same row twice"), (4, "same id, other text"),
            (5, "zero \x00 and é 日本 \U0001f600 İΣ  two  spaces \n new"), (6, words(30_000, 1)), (7, "x"), (8, "!" * 500)]
