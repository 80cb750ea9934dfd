import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, bucket int, size long, row_id string"
COLUMNS = SCHEMA.count(",") + 1


def prose(dice, n, words):
    return " ".join(dice.choice(words) + ("." if i % 9 == 8 else "") for i in range(n))


def vocabulary(dice, letters, n=300):
    return ["".join(dice.choice(letters) for _ in range(dice.randint(2, 8))) for _ in range(n)]


def row(doc_id, text, lang="en", source="a"):
    """A document with columns whose names clash with those that operators make."""
    return (doc_id, text, lang, source, None, True, 0.5, 3, 7, "r")


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text, lang, source): two languages, near and exact copies, and every odd text."""
    dice = random.Random(5)
    en, fr = vocabulary(dice, "abcdefghinorst"), vocabulary(dice, "éèàuvxyzjqlmç")
    out = []
    for i in range(60):
        words, lang = (en, "en") if i % 3 else (fr, "fr")
        out.append((i, prose(dice, 40 + i * 3, words), lang, ["a", "b", "c", None][i % 4]))
    base = prose(dice, 200, en).split()
    for i in range(60, 80):  # near copies, some of them too far apart
        copy = list(base)
        for _ in range(i - 60):
            copy[dice.randrange(200)] = "zz%d" % dice.randrange(1000)
        out.append((i, " ".join(copy), "en", "a"))
    out += [(80 + i, out[7][1], "en", "b") for i in range(4)]
    out += [(84, out[7][1].upper(), "en", "b")]
    out += [
        (90, None, None, None), (91, "", "en", "a"), (92, " \t\n\v\f\r ", "en", "a"), (93, "one", "en", "a"), (94, "one two", "en", None),
        (95, "One  two", "fr", "a"), (96, "123 456 --- ###", "en", "b"), (97, prose(dice, 30_000, en), "en", "a"), (98, "Und " * 500, "de", "c"),
        (99, "x\u00a0y \u2003 z\x1c w", "en", "c"), (100, "ÀÉ " * 3 + "\U0001f600 e\u0301", "fr", "c"), (None, "no id at all here", "en", "a"), (101, "a b c d " * 40, "en", "a"),
    ]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [row(*t) for t in texts]
    return spark.createDataFrame(rows + rows[-1:] + rows[5:6], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def folder(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


@pytest.fixture
def empty_folder(spark, no_docs, tmp_path):
    no_docs.write.parquet(str(tmp_path / "e" / "documents.parquet"))
    return str(tmp_path / "e")
