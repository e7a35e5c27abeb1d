import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from spillway.llm.queries import op4_sentencepiece
from spillway.llm.sentencepiece_codec import BLANK, Codec, Pieces, refuse_crossing, sentencepiece_round_trip
from tests.oracle import DATA

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
PIECES = Pieces(MODEL)
CODEC = Codec(PIECES)


def _merged(text):
    """Brute force: of all neighbours that join to a piece, the best, the leftmost of equals, until none is left."""
    if not text:
        return []
    names = {t: i for i, t in enumerate(PIECES.texts) if not (LIBRARY.is_byte(i) or LIBRARY.is_control(i) or LIBRARY.is_unknown(i))}
    parts = list(BLANK + text.replace(" ", BLANK))
    while True:
        best = min(((-LIBRARY.get_score(names[a + b]), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in names), default=None)
        if best is None:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return [i for p in parts for i in ([names[p]] if p in names else PIECES.bytes_of[list(p.encode())].tolist())]


def ids(texts):
    return [np.frombuffer(x, "<i4").tolist() for x in CODEC.encode(texts)]


CASES = ["", " ", "a", " a", "  a  b", "a\nb", "a \n b", "\t", "ﬁ é", "数学\U0001f600", "▁x", "a▁b", "<s>x", "<0x41>", "x\r\ny", "Ⅷ", "\xa0z", "a\x00b", "x" + " " * 70 + "y", "a" * 40, "banana bandana", "\n\n", "  \n  ", "it's we'll", "e" * 70_000]


def test_equals_library_and_brute_force():
    assert ids(CASES) == LIBRARY.encode(CASES)
    assert ids(CASES[:-1]) == [_merged(t) for t in CASES[:-1]]
    assert [CODEC.decode(x) for x in CODEC.encode(CASES)] == [t.replace(BLANK, " ") for t in CASES]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aeinst hr \n▁."), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=4))
def test_any_text(texts):
    assert ids(texts) == LIBRARY.encode(texts)
    assert [CODEC.decode(x) for x in CODEC.encode(texts)] == [t.replace(BLANK, " ") for t in texts]


def test_suffix_ranges():
    codec = Codec(PIECES)
    text = "banana band"
    codes = codec.code[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    order, keys = codec._suffixes(codes)
    k = codec.piece.tolist().index(PIECES.ids["an"])
    first, last = (codec._bisect(keys, [x[k : k + 1] for x in w], after)[0] for w, after in ((codec.low, False), (codec.high, True)))
    assert sorted(order[first:last].tolist()) == [1, 3, 8]


def test_query(spark, odd, none):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in op4_sentencepiece(spark, f"{DATA}/sf0.001").collect()}
    want = LIBRARY.encode([r["text"] for r in docs])
    assert all(got[r["doc_id"]]["ids"] == w and got[r["doc_id"]]["n_ids"] == len(w) and got[r["doc_id"]]["decoded"] == r["text"] for r, w in zip(docs, want, strict=True))
    rows = sentencepiece_round_trip(odd, MODEL).collect()
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in rows) == sorted((str(r["doc_id"]), r["text"] or "") for r in odd.collect())
    assert sentencepiece_round_trip(none, MODEL).count() == 0


@pytest.mark.parametrize("text", ["ab" * 300, "lorem ipsum " * 200])
def test_long_parts(text):
    assert ids([text]) == LIBRARY.encode([text])


def test_very_long_texts():
    texts = [f"Word {i} né " * 9 for i in range(3000)]
    long = "".join(texts) + "x" * 5000 + "\n" + "the " * 50_000
    assert ids([long]) == LIBRARY.encode([long]) and CODEC.decode(CODEC.encode([long])[0]) == long


def test_models_with_crossing_pieces_are_refused():
    refuse_crossing([BLANK, BLANK + "a", "b", "\n"])
    for bad in ("a" + BLANK, BLANK + "a" + BLANK, "a\n"):
        with pytest.raises(ValueError):
            refuse_crossing([bad])
