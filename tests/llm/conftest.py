"""Small tables with what real ones hold at worst: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

import pytest

#: Names that operators use inside or add; as extra columns they must do no harm.
CLASHING = "id fp key doc row start stop size copies target source_size _size _source _target _copy c0 c1 c2 k0 k1 n_lines n_dropped keys _keys _doc shard cuckoo held_out lang_pred score vec cid grp label_ host path keep_id group_size kept _gone _id _norm _digest component_id fingerprint node root".split()
WORDS = "the of and to in is that for on with as was at by from this river stone garden winter signal market engine letter silver morning, bridge. Window? été große niño".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows_of_documents():
    """(doc_id, text, lang, source, n_chars)"""
    rng = random.Random(7)
    shared = [sentence(rng, 14) for _ in range(4)]
    out = []
    for k in range(60):
        lines = [sentence(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 6))]
        if k % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), rng.choice(shared))
        if k % 7 == 0:
            lines.insert(0, f" \t{shared[0].upper()}\r")
        out.append([k * 3 - 20, "\n".join(lines), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "b", "b", None]), None])
    for k in (3, 11, 19):  # exact copies, and copies but for white space
        out.append([400 + k, out[k][1], "en", "c", 5])
        out.append([500 + k, out[k][1].replace(" ", "  ") + "\n", "en", "b", 5])
    out += [[600, None, "en", "a", 0], [601, "", "en", "a", 0], [602, " \t\n", None, None, 3], [603, None, None, "b", None]]
    out += [[604, "\n".join([shared[1]] * 3 + ["x"] * 2), "en", "a", 1], [605, "\n\n" + shared[1] + "\n", "en", "a", 1]]
    out += [[606, "a", "de", "d", 1], [607, "é" * 19 + "\n" + "é" * 20, "de", "d", 1], [608, "\U0001f600 \U0001f600 İ x y\x00z", "de", "d", 1]]
    out.append([700, "\n".join(sentence(rng, 40) for _ in range(400)), "en", "a", 1])  # a long text in lines
    out.append([701, sentence(rng, 12_000), "en", "e", 1])  # and one in a single line
    return [tuple(x) for x in out]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def rows():
    return rows_of_documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Documents with unique keys."""
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd(spark, rows):
    """The same with repeated rows, a null key, a null in every column, and clashing columns."""
    from pyspark.sql import functions as F

    more = [*rows[:5], *rows[:5], (None, "nobody's text in a line that is long enough", "en", "a", 1), (None, None, None, None, None)]
    df = spark.createDataFrame([*rows, *more], SCHEMA).repartition(3)
    return df.select("*", *[(F.lit(k) if k % 2 else F.lit(None).cast("string")).alias(c) for k, c in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
