"""Small tables with nulls, empty and very long texts, repeated rows and clashing names."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(seed: int, n: int) -> str:
    return " ".join(f"{WORDS[(seed * 7 + k * k + 3 * k) % len(WORDS)]}{(seed * 31 + k) % 89}" for k in range(n))


#: Names an operator could use inside; none may disturb it.
CLASHING = "digest string, fp long, length long, _key string, _sha string, _hits string, score double, sha string, start long, node long"


def documents(spark, rows):
    """``rows`` of (id, text) with columns whose names clash."""
    extra = ("x", 1, 2, "k", "s", "h", 0.5, "sha", 3, 4)
    return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, {CLASHING}")


def odd_rows():
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, sentence(1, 60)), (5, sentence(1, 60)), (5, sentence(1, 60)), (6, sentence(2, 5000)),
        (None, sentence(3, 20)), (None, None), (7, "x" * 50_000), (8, "Ünïcödé 漢字 " * 30), (9, "a"), (10, sentence(4, 70) + " " + sentence(1, 60)),
    ]
