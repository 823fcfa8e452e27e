import numpy as np
import pytest

from pairweave.llm.toxicity import CharModel, Model, respace


@pytest.fixture(scope="module")
def model():
    chars = CharModel()
    for word, n in [("stupid", 50), ("idiot", 50), ("the", 500), ("this", 300), ("is", 300), ("you", 200), ("are", 200), ("a", 300), ("man", 50), ("class", 50), ("as", 200), ("house", 100)]:
        chars.add(word, n)
    return Model(chars, {"stupid ": 0.9, "stup": 0.9, "idiot ": 0.9, "ass ": 0.9}, np.zeros(0), 0.0)


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("a i d i o t", ["a", "idiot"]),
        ("you are a s t u p i d", ["you", "are", "a", "stupid"]),
        ("t h i s i s s t u p i d", ["this", "is", "stupid"]),
        ("the st up id man", ["the", "stupid", "man"]),
        ("a $ t u p 1 d", ["a", "stupid"]),
        ("i d i o o o o t", ["idiot"]),
        ("is a", ["is", "a"]),
    ],
)
def test_borders(model, text, words):
    found = respace(text.split(), model.chars)
    assert [w for _, w in found] == words and sum(n for n, _ in found) == len(text.split())


def test_words_of_a_run_are_evidence(model):
    texts = [b"you are a s t u p i d", b"t h i s i s s t u p i d", b"the st up id man", b"idi ot", b"house a i d i o t house", b"t h e c l a s s", b"you are as the man", b"1 2 3 4", None]
    assert (model.signals(texts)[:, 1] > 0).tolist() == [True] * 5 + [False] * 4


def test_long_runs(model):
    assert respace(["s", "t", "u", "p", "i", "d"] * 500, model.chars) == [(6, "stupid")] * 500
