"""Small tables with awkward rows: nulls, empty and long texts, repeats, clashing column names."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, shard string, root string, entry string, score string"


def row(i, text, source="src0"):
    return (i, text, "en", source, len(text or ""), 1, "x", "y", "z", "s")


def prose(r, n):
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def near(r, text, changes):
    w = text.split(" ")
    for _ in range(changes):
        w[r.randrange(len(w))] = "edit" + str(r.randrange(10**6))
    return " ".join(w)


def documents():
    """About 120 rows: exact and near copies, a chain of near copies, shared passages and lines, one long text."""
    r = random.Random(5)
    rows = []
    base = prose(r, 120)
    passage = prose(r, 60)
    for i in range(30):
        rows.append(row(i, near(r, base, i % 12), f"src{i % 4}"))
    chain = prose(r, 100)
    for i in range(30, 45):
        chain = near(r, chain, 4)
        rows.append(row(i, chain, "src0"))
    for i in range(45, 75):
        rows.append(row(i, prose(r, 30 + i), None if i % 7 == 0 else "src1"))
    for i in range(75, 90):
        rows.append(row(i, prose(r, 12) + "\nSHARED  line of all\n" + prose(r, 3) + " " + passage + " " + prose(r, 8) + "\n\n" + prose(r, 5), "src2"))
    for i in range(90, 100):
        rows.append(row(i, "same text everywhere \n shared LINE of all "))
    rows += [row(100, None), row(101, ""), row(102, "   \n\t "), row(103, "one"), row(104, "One"), row(105, "two words"), row(106, "be " * 400), row(107, "été naïve Ünïcode ß " * 40), row(108, prose(r, 4000))]
    rows += [row(None, "a row with no id at all"), row(None, None), row(45, rows[45][1]), row(46, "other text under a known id")]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def unique(rows):
    """Rows with an id of their own: the first of each."""
    seen, out = set(), []
    for x in rows:
        if x[0] is not None and x[0] not in seen:
            seen.add(x[0])
            out.append(x)
    return out
