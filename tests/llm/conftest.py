import pytest

LONG = "lorem ipsum dolor sit amet " * 4000

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept int, host string, n_words string, path int, `class` int, label string, piece string, `odd name` int, _row int"


def rows():
    """Documents with nulls, empty and very long texts, repeated rows, shared ids, and columns with clashing names."""
    texts = [(1, "a b c d e f g h i j"), (1, "a b c d e f g h i j"), (2, None), (3, ""), (4, " \n\t "), (None, "x y z"), (None, None), (5, LONG), (6, LONG), (7, "One two."), (7, "another text of the same id here now"), (8, "Ünïcödé ß İ x y 数学 \U0001f600 é."), (9, "a  b\n\nc\td\r\ne\x00f"), (10, "A b c d e f g h i j")]
    return [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 2}", None, "s", 1, "h", None, 2, 3, "l", None, 4, 5) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
