"""A worker that goes on to another operator lets go of what the one before it kept."""

from rasterlake.llm import bpe, common, decontaminate, jaccard


def test_beginning_a_task_clears_the_caches_of_others_only():
    jaccard.shingles("some words that are hashed and kept")
    auto = bpe.automaton(open(bpe.default_tokenizer(), encoding="utf-8").read())
    decontaminate._LOADED["nowhere"] = object()
    common.begin_task("bpe")
    assert not jaccard._HASHES and not decontaminate._LOADED and list(bpe._COMPILED.values()) == [auto]
    common.begin_task("jaccard")
    assert not bpe._COMPILED


def test_results_are_the_same_after_caches_are_cleared():
    text = "one two three four five six seven " * 20
    spec = open(bpe.default_tokenizer(), encoding="utf-8").read()
    ids, grams = bpe.automaton(spec).encode(text), jaccard.shingles(text)
    common.begin_task("quality")
    assert bpe.automaton(spec).encode(text) == ids
    assert (jaccard.shingles(text) == grams).all()
