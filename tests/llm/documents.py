import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, copies int, kept boolean, n_words long, component_id long"


def nasty_texts() -> list:
    """Null, empty, blank, short, odd, repeated and long texts, and near copies of some of them."""
    rnd = random.Random(4)
    vocabulary = ["alpha", "Beta", "gam\u00e7a", "\u6f22\u5b57", "d\u00a0d", "e,", "#f", "G", "\U0001f600", "h|h"] + [f"w{i}" for i in range(300)]

    def prose(n):
        return " ".join(rnd.choice(vocabulary) for _ in range(n))

    passage, long = prose(60), prose(20_000)
    base = prose(200).split(" ")
    near = [base[:], base[:], base[:]]
    for i, words in enumerate(near):
        words[10 + 50 * i] = f"changed{i}"
    texts = [None, "", " \t\n\x0b\x0c\r", "one", "One two", "one two three four", "a b c d e", "A B C D E", "a b c d e f", long, long,
             prose(80) + " " + passage + "\n" + prose(30), passage + " " + prose(50), " ".join(base), *[" ".join(w) for w in near],
             "same " * 100, "x y " * 40, "line one here\nline two\nline one here\n\n \nline two", prose(40) + "\u2581 \u2581\u2581<s>", "  lead  and\ttabs  ",
             "\x1c\x85 odd\u2003spaces"]
    return texts + [prose(rnd.randint(1, 90)) for _ in range(30)]


def nasty_rows() -> list[tuple]:
    sources = [None, "b", "a", "\u00e9", "B"]
    rows = []
    for i, text in enumerate(nasty_texts()):
        rows.append((i * 7 - 3, text, "en" if i % 3 else None, sources[i % 5] if i % 4 else "a", len(text or ""), 5, 9, 1, None, i, None))
    rows += [rows[11], rows[11], rows[1], rows[0]]  # repeated rows
    rows.append((None, "no id " * 20, None, None, None, None, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None, None, None, None))
    rows.append((rows[12][0], "another text under an id that is taken", "en", "a", 3, 1, 1, 1, True, 1, 1))
    return rows


@pytest.fixture(scope="session")
def nasty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("nasty") / "docs")
    spark.createDataFrame(nasty_rows(), DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("nothing") / "docs")
    spark.createDataFrame([], DOCS).write.parquet(path)
    return spark.read.parquet(path)
