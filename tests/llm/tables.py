"""Small tables with the awkward cases, shared by the tests of this folder."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def documents(spark, rows):
    """(doc_id, text, source) rows with columns whose names the operators use inside."""
    schema = "doc_id long, text string, source string, key string, n long, pos int, lang string, n_chars long"
    return spark.createDataFrame([(i, t, s, "k", 1, 2, "en", len(t or "")) for i, t, s in rows], schema)
