import re

import pytest

from goldsieve.llm.language import LETTERS, Labeller, Network


@pytest.mark.parametrize("word", ["हिन्दी", "ภาษาที่", "مَرْحَبًا", "été", "plain", "été"])
def test_words_keep_their_marks(word):
    assert LETTERS.findall(f"1 {word}, {word}_2 ́") == [word, word]


def test_every_byte_of_a_marked_word_is_labelled():
    labeller = Labeller(Network(["a", "b"]))
    labeller.label(["हिन्दी"])
    assert labeller.sizes.tolist() == [len("हिन्दी".encode())]


def test_words_without_marks_are_as_before():
    text = "Straße, l'été 2024: foo_bar x1y — 漢字!"
    assert LETTERS.findall(text) == re.findall(r"[^\W\d_]+", text)


def test_numerals_are_no_letters(docs):
    assert LETTERS.findall("½ ² ① Ⅷ 3") == []
    labeller = Labeller(Network(["a", "b"]))
    assert [label for label, _ in labeller.label(["½ ² ① Ⅷ", "a½", None])] [::2] == ["und", "und"]
