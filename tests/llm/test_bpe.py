import hashlib
import random

import numpy as np
import pytest

bpe = pytest.importorskip("lodeframe.llm.bpe")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def merged(word, merges):
    """Merges in order of rank, each from left to right over the whole word."""
    tokens = list(word)
    for u, v in merges:
        i, out = 0, []
        while i < len(tokens):
            both = tokens[i : i + 2] == [u, v]
            out.append(u + v if both else tokens[i])
            i += 1 + both
        tokens = out
    return tokens


def test_automaton_equals_merging_for_random_merges():
    rng = random.Random(5)
    for _ in range(60):
        tokens, merges = list("abc"), []
        for _ in range(rng.randrange(1, 14)):
            u, v = rng.choice(tokens), rng.choice(tokens)
            if u + v not in tokens:
                tokens.append(u + v)
                merges.append((u, v))
        automaton = bpe.Automaton({t: i for i, t in enumerate(tokens)}, merges)
        words = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 14))) for _ in range(60)]
        ids, counts = automaton.encode_many(words)
        ends = np.cumsum(counts).tolist()
        for word, a, b in zip(words, [0, *ends], ends, strict=False):
            told = merged(word, merges)
            assert [tokens[i] for i in ids[a:b]] == told
            assert [tokens[i] for i in automaton.encode(word)] == told
            # a path of the automaton spells the correct tokens, and no other pair of neighbours is one
            assert all(automaton.has(tokens.index(x), tokens.index(y)) for x, y in zip(told, told[1:], strict=False))


def test_gadget_of_a_doubled_token():
    automaton = bpe.Automaton({"a": 0, "aa": 1}, [("a", "a")])
    assert automaton.encode("aaa") == [1, 0]
    assert not automaton.has(0, 0) and not automaton.has(0, 1) and automaton.has(1, 0) and automaton.has(1, 1)


def test_a_merge_that_can_never_happen_makes_no_arc():
    # b and c are joined before a and b can be, so abc is a + bc and "ab" + "c" is never reached
    vocab = {t: i for i, t in enumerate(["a", "b", "c", "bc", "ab", "abc"])}
    automaton = bpe.Automaton(vocab, [("b", "c"), ("a", "b"), ("ab", "c")])
    assert automaton.encode("abc") == [0, 3] and automaton.encode("ab") == [4] and vocab["abc"] not in automaton.born


def test_merges_must_be_in_order():
    with pytest.raises(ValueError):
        bpe.Automaton({"a": 0, "b": 1, "ab": 2, "aba": 3}, [("ab", "a"), ("a", "b")])
    with pytest.raises(ValueError):
        bpe.Automaton({"a": 0}, []).encode("ab")


TEXTS = [
    None, "", " ", "a", "Hello world", " leading", "trailing ", "two  spaces", "three   spaces\n\n\nlines", "x \n y", "tab\tbed", "it's we'll I'd", "a <|endoftext|> b", "<|endoftext|><|endoftext|>x",
    "x" * 3000, "word " * 3000, "=" * 500, "1234 5,678.90 +++ ### &&&", "日本語 テキスト 😀 ok", "a\x1c b", "end\n", "\x85 a \x85b", "line one\nline two | cell | \r\n x", "é" * 100, "Ġ ġ aĠb",
]


def test_encodes_and_decodes_as_the_tokenizer_does(spark, tokenizer):
    rng = random.Random(0)
    kinds = ["a", "B", " ", "  ", "\n", "'s", "9", "é", ".", "\t", " ", "日", "ing", "==", "<|", "|>", "<|endoftext|>", "\x1c"]
    texts = TEXTS + ["".join(rng.choice(kinds) for _ in range(rng.randrange(60))) for _ in range(300)] + ["".join(chr(rng.randrange(33, 127)) for _ in range(200)) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r.doc_id: r for r in bpe.encode(docs, PATH, with_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert list(rows[i].ids) == ids and rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_decodes_any_ids(spark, tokenizer):
    rng = random.Random(1)
    ids = [[rng.randrange(50257) for _ in range(20)] for _ in range(200)] + [[]]
    coded = spark.createDataFrame([(i, x, "old") for i, x in enumerate(ids)] + [(-1, None, "old")], "k int, ids array<int>, text string")
    got = {r.k: r.text for r in bpe.decode(coded, PATH).collect()}
    assert got.pop(-1) is None and got == {i: tokenizer.decode(x, skip_special_tokens=False) for i, x in enumerate(ids)}


def test_caches_that_are_full_are_begun_again(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    coder = bpe.Words(PATH)
    for _ in range(2):
        for t in ("one two three four", "five six seven eight nine ten", "one two  three"):
            assert coder([t])[0] == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_empty_table_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, None, 1, 2), (7, "a", 1, 2), (7, "a", 1, 2)], "doc_id long, text string, n_tokens int, ids int")
    rows = bpe.encode(docs, PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 0), (7, 1), (7, 1)]
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        bpe.Words(public_tokenizers.path("word_bpe_49k.json"))
