import random

import pytest
from tokenizers import Tokenizer, models

from cuesheet.llm import tokens

SCHEMA = "doc_id long, text string, n_tokens string"


@pytest.fixture(scope="module")
def raw():
    return tokens.read_model()


def reference(pieces):
    """Counts by a public tokenizer of the same kind; unknown characters as bytes."""
    model = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces.items()], 0, False))

    def count(text):
        e = model.encode(tokens.normalized(text or ""))
        return sum(1 if i else len(t.encode()) for i, t in zip(e.ids, e.tokens))

    return count


ODD = ["", " ", "   a", "a  b   c ", "\n\t x", "日本語 and 漢字𠀀𠀀", "▁x ▁", "😀😀 é à̀", "the " * 9, "x" * 5000, "thethethe" * 3000, "\x00"]


def test_counts_equal_a_tokenizers(raw):
    counter = tokens.Counter(tokens.vocabulary(raw))
    assert counter.split is not None
    count = reference(counter.known.pieces)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choices("abethin ou.\n", k=rng.randint(1, 300))) for _ in range(300)]
    assert [counter.count(t) for t in texts] == [count(t) for t in texts]


def test_ties_and_unknown_characters():
    rng = random.Random(2)
    for _ in range(60):
        pieces = {"".join(rng.choices("abc▁", k=rng.randint(1, 4))): float(-rng.randint(0, 3)) for _ in range(25)}
        known = tokens.Vocabulary(pieces, min(pieces.values()) - 10)
        counter, count = tokens.Counter(known), reference(pieces)
        for _ in range(40):
            text = "".join(rng.choices("abc dé", k=rng.randint(1, 25)))
            assert counter.count(text) == count(text), (pieces, text)


def test_query(spark, raw):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, None, None), (3, "a", ""), (3, "a", "")]
    out = tokens.token_counts(spark.createDataFrame(rows, SCHEMA), raw)
    assert out.columns == ["doc_id", "n_tokens"] and out.count() == len(rows)
    assert {r.n_tokens for r in out.where("doc_id is null").collect()} == {0}
    assert tokens.token_counts(spark.createDataFrame([], SCHEMA), raw).count() == 0
