import json
import random

import pytest

from rasterlake.llm import bpe


def vocabulary(seed, letters="abcd", merges=14):
    """A byte-level vocabulary with merges drawn at random from tokens there are; many of them can never happen."""
    r = random.Random(seed)
    tokens, pairs = list(letters), []
    while len(pairs) < merges:
        a, b = r.choice(tokens), r.choice(tokens)
        if (a, b) not in pairs:
            pairs.append((a, b))
            if a + b not in tokens:
                tokens.append(a + b)
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": {t: k for k, t in enumerate(tokens)}, "merges": [list(p) for p in pairs]}})


def test_random_vocabularies_with_merges_that_never_happen():
    from tokenizers import Tokenizer

    lost = 0
    for seed in range(250):
        spec = vocabulary(seed, merges=4 + seed % 20)
        auto, library = bpe.TokenAutomaton(spec), Tokenizer.from_str(spec)
        lost += len(json.loads(spec)["model"]["vocab"]) - len(auto.reachable)
        r = random.Random(seed)
        for n in (*range(1, 9), *range(1, 40)):
            word = "".join(r.choice("abcd"[: 1 + n % 4]) for _ in range(n))
            assert auto.encode_word(word.encode()) == library.encode(word).ids, (seed, word)
    assert lost > 100  # tokens that no text has


def test_a_merge_that_an_earlier_one_prevents():
    spec = json.dumps({"added_tokens": [], "model": {"vocab": {t: k for k, t in enumerate(["a", "b", "c", "bc", "ab", "abc"])}, "merges": ["b c", "a b", "ab c"]}})
    auto = bpe.TokenAutomaton(spec)
    assert auto.encode_word(b"abc") == [0, 3] and auto.encode_word(b"ab") == [4] and 5 not in auto.reachable


def test_tables_that_are_emptied_give_the_same():
    spec = vocabulary(3, merges=24)
    wide, narrow = bpe.TokenAutomaton(spec), bpe.TokenAutomaton(spec, word_cache=2, word_chars=3, states=4, arc_cache=2)
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice("abcd") for _ in range(r.randint(1, 30)))
        assert wide.encode(text) == narrow.encode(text)
    assert len(narrow.words) <= 2 and all(len(w) <= 3 for w in narrow.words) and len(narrow.last) < 40


def test_states_stay_bounded_within_a_word():
    from tokenizers import Tokenizer

    spec = open(bpe.default_tokenizer(), encoding="utf-8").read()
    library, auto = Tokenizer.from_str(spec), bpe.TokenAutomaton(spec, states=3000)
    r = random.Random(2)
    for n, letters in ((60_000, "abcdefghijklmnopqrstuvwxyz"), (20_000, "etaoinéß日本"), (9000, "=-+/*")):
        word = "".join(r.choice(letters) for _ in range(n))
        ids = auto.encode_word(word.encode())
        assert ids == library.encode(word, add_special_tokens=False).ids
        assert len(auto.last) <= 3002 and len(auto.table) <= 256 * len(auto.last)
    for seed in range(40):
        small = vocabulary(seed, merges=20)
        narrow, exact = bpe.TokenAutomaton(small, states=2), Tokenizer.from_str(small)
        for n in range(1, 60):
            word = "".join(r.choice("abcd") for _ in range(n))
            assert narrow.encode_word(word.encode()) == exact.encode(word).ids


@pytest.mark.parametrize("change", [
    {"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"model": {"ignore_merges": True}},
    {"model": {"byte_fallback": True}}, {"model": {"end_of_word_suffix": "</w>"}}, {"added_tokens": [{"id": 0, "content": "a", "lstrip": True}]}, {"model": {"type": "Unigram"}},
])
def test_settings_that_are_not_supported(change):
    data = json.loads(vocabulary(1))
    for k, v in change.items():
        data[k] = {**data[k], **v} if k == "model" else v
    with pytest.raises(ValueError, match="not supported"):
        bpe.TokenAutomaton(json.dumps(data))


def test_very_long_word_and_repeated_texts(spark):
    docs = spark.createDataFrame([(1, "ab" * 200_000, 1), (1, "ab" * 200_000, 1), (2, "x", 2)], "doc_id long, text string, ids int")
    rows = bpe.encode_documents(docs, bpe.default_tokenizer(), outputs=("ids", "decoded")).collect()
    assert sorted(r.decoded for r in rows) == ["ab" * 200_000, "ab" * 200_000, "x"]
