"""Ids by parts against the tokenizer itself."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidegauge.llm import tokens

ODD = "aBJ é\n\t   　\x1c'sT.,!12ß̌́̈中​\r\x85İΣ<|>²ª   cdeXY"


@pytest.mark.parametrize("stretch", [1_000_000, 8])
@pytest.mark.parametrize(("name", "parts", "folds"), [("word_bpe_49k.json", tokens.WORDS, True), ("byte_bpe_50k.json", tokens.LEADING_SPACE, False)])
def test_ids_equal_those_of_the_whole_text(name, parts, folds, stretch, monkeypatch):
    monkeypatch.setattr(tokens, "STRETCH", stretch)
    monkeypatch.setattr(tokens, "REMEMBERED", 2000)  # entries are dropped on the way
    rng = random.Random(3)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(20_000)]
    texts += ["", "  ", "<|endoftext|> x <|STARTOFTEXT|>", "x" * 5000 + " Y" * 100, "don't DON'T Wo,rd WORD, word. 'S"]
    special = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", " ", "  ", "\n", "a", "B", "1", ".", "'s", "é"]
    texts += ["".join(rng.choice(special) for _ in range(rng.randint(1, 9))) for _ in range(5000)]
    ours = tokens.PartEncoder(public_tokenizers.path(name), parts, folds)
    theirs = Tokenizer.from_file(public_tokenizers.path(name))
    for a in range(0, len(texts), 500):
        some = texts[a : a + 500]
        wanted = [e.ids for e in theirs.encode_batch_fast(some, add_special_tokens=False)]
        assert [x.tolist() for x in ours.ids(some)] == wanted


def test_words_that_differ_in_capitals_are_merged_once_by_the_shorter_way(monkeypatch):
    """New words of a folding tokenizer are encoded in small letters, cut at blanks, without the normalizer."""
    path = public_tokenizers.path("word_bpe_49k.json")
    ours, theirs, learned = tokens.PartEncoder(path, tokens.WORDS, True), Tokenizer.from_file(path), []
    joined = ours._joined
    monkeypatch.setattr(ours, "_joined", lambda parts, glue, out, by: (learned.extend(parts if by is ours.cutter else []), joined(parts, glue, out, by)))
    assert ours.cutter is not ours.joined
    text = "ÉTÉ été Été zyxq ZYXQ, Zyxq. " + "Y" * 100 + " ÀÖØÞß straße"
    for some in (text, text.swapcase(), "zyXQ " + text):
        assert ours.ids([some])[0].tolist() == theirs.encode(some, add_special_tokens=False).ids
    assert len(learned) == len(set(learned)) and learned.count("zyxq") == 1 and learned.count("été") == 1


def test_known_parts_are_neither_cut_nor_merged_again_and_texts_go_in_bounded_groups(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    ours, theirs = tokens.PartEncoder(path, tokens.WORDS, True), Tokenizer.from_file(path)
    monkeypatch.setattr(tokens, "STRETCH", 60)
    monkeypatch.setattr(tokens, "REMEMBERED", 40)
    often = "Often, often used; don't forget (it)."
    sizes, inner = [], ours._ids
    monkeypatch.setattr(ours, "_ids", lambda some: (sizes.append(sum(map(len, some))), inner(some))[1])
    rng = random.Random(7)
    rare = ["".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(400)]
    for a in range(0, len(rare), 4):
        some = [often, " ".join(rare[a : a + 4]), "", often]
        assert [x.tolist() for x in ours.ids(some)] == [theirs.encode(x, add_special_tokens=False).ids for x in some]
    assert max(sizes) <= 60 and len(ours.places) <= 2 * 40

    class Uncalled:
        def findall(self, text):
            raise AssertionError("cut again")

    monkeypatch.setattr(ours, "parts", Uncalled())
    assert ours.ids([often])[0].tolist() == theirs.encode(often, add_special_tokens=False).ids
