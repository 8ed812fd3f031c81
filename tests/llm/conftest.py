import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _row int, size string, removed string, words string, n_words int, class int"


def document_rows():
    """Documents with nulls, copies, near copies, ties, repeated rows and very long texts."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(900)]

    def prose(n):
        return "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(5, 30))) for _ in range(n))

    texts = [prose(rng.randint(1, 9)) for _ in range(60)]
    for text in texts[:14]:  # near copies, of which some drift away step by step
        for _ in range(3):
            parts = text.split(" ")
            for _ in range(max(1, len(parts) // 40)):
                parts[rng.randrange(len(parts))] = rng.choice(words)
            text = " ".join(parts)
            texts.append(text)
    passage = prose(8)
    texts += [prose(2) + "\n" + passage + "\n" + prose(3) for _ in range(6)] + [passage * 2, "ab" * 1500, "x" * 2100]
    texts += [texts[3]] * 5 + ["", " \t\n", "one", "One two", "éÀ ñ 日本語のテキスト", "A B <|endoftext|> c", "# $ % &"]
    texts += [prose(900), "Wo\rrd\x0bx\x0cy " * 40, texts[5].upper(), texts[6].replace(" ", "  ")]
    for _ in range(4):  # copies whose lines break elsewhere
        words_of = (text := prose(9)).split()
        texts += [text, "\n".join(" ".join(words_of[a : a + 45]) for a in range(0, len(words_of), 45))]
    rows = [(i, t, "en", "src0", len(t), "no", 7, "big", "x", "w", 1, 2) for i, t in enumerate(texts)]
    rows.append((len(rows), None, None, None, None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def odd_rows():
    """As above, with null ids and rows that repeat an id."""
    rows = document_rows()
    return rows + [(None, *rows[1][1:]), (None, None, *rows[1][2:]), rows[2], (4, "another text of the same id " * 9, *rows[1][2:])]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(document_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def pairs():
    return [(r[0], r[1]) for r in document_rows()]


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
