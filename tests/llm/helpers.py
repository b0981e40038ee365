"""Small fixtures: texts with copies, shared passages, odd rows."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(901, None, None, "s", 0), (902, "", "en", "s", 0), (903, "   \n\t ", "en", "s", 6), (904, "!!! ???", "en", None, 7), (None, "no id here at all", "en", "s", 17), (905, "x" * 5000, "en", "s", 5000), (906, "a " * 3000, "en", "s", 6000)]


def words(rng, n):
    return [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.randint(0, 99)}" for _ in range(n)]


def rows(seed=1, n=30, long=80):
    rng = random.Random(seed)
    shared = words(rng, 50)
    out = []
    for i in range(n):
        w = words(rng, rng.randint(1, long))
        if i % 3 == 0:
            at = rng.randint(0, len(w))
            a, b = sorted((rng.randint(0, 50), rng.randint(0, 50)))
            w[at:at] = shared[a:b] if i % 2 else shared
        out.append((i, rng.choice([" ", "  ", "\n"]).join(w), "en", f"s{i % 3}", 0))
    out += [(100 + i, out[i][1], "en", "s0", 0) for i in range(5)]
    return out + ODD


def table(spark, data, schema=DOCS):
    return spark.createDataFrame(data, schema)


def clashing(df):
    """Extra columns with the names that operators might use."""
    from pyspark.sql import functions as F

    for name in ("b", "w", "keys", "score", "cid", "class_id", "toxicity", "TOXICITY_", "contaminated", "lang_pred", "quality_score", "__id", "__cid", "ok"):
        df = df.withColumn(name, F.lit("x"))
    return df
