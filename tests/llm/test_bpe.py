import random

import public_tokenizers
import pytest
import regex
import tiktoken

from tuplemill.llm.bpe import Encoder, PieceState, Splitter, encode_documents, load_ranks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = ["a", "b", "the", " ", "e", "r", "in", "\n", "1", "é", "ñ", "中", "😀", "!!", "$$$", "aaaa", "'s", "'", "'ll", "'re", "'v", "e", "\t", "zz", "ion", " ", "٣"]


@pytest.fixture(scope="module")
def both():
    ranks = load_ranks(PATH)
    return Encoder(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n, most):
    rng = random.Random(1)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_the_laid_out_pattern_is_the_tokenizers():
    assert Splitter.DEFAULT == public_tokenizers.PATTERN


def test_ids_equal_tiktoken(both):
    ours, theirs = both
    for t in texts(3000, 30) + ["a" * 5000, "ab" * 3000]:
        ids = ours.encode(t)
        assert ids == theirs.encode_ordinary(t)
        assert ours.decode(ids) == t.encode()


def test_another_pattern(both):
    ours = Encoder(load_ranks(PATH), r"\w+|\W+")
    for t in texts(50, 20):
        assert ours.encode(t) == [i for p in regex.findall(r"\w+|\W+", t) for i in ours.vocabulary.encode_piece(p.encode())]


def test_appends_and_edits_keep_the_encoding_exact(both):
    ours, _ = both
    rng = random.Random(5)
    state = PieceState(ours.vocabulary)
    for _ in range(300):
        new = "".join(rng.choice("aeinrst") for _ in range(rng.randint(0, 6))).encode()
        if rng.random() < 0.5:
            state.append(new)
        else:
            a = rng.randint(0, len(state.piece))
            state.replace(a, rng.randint(a, min(len(state.piece), a + 5)), new)
        assert state.ids() == PieceState(ours.vocabulary, state.piece).ids() == (ours.vocabulary.encode_piece(state.piece))


def test_documents(corpus, empty, both):
    import hashlib

    theirs = both[1]
    got = {r["doc_id"]: r for r in encode_documents(corpus, PATH, public_tokenizers.PATTERN).collect()}
    rows = corpus.collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = theirs.encode_ordinary(r["text"] or "")
        g = got[r["doc_id"]]
        assert g["ids"] == ids and g["n_tokens"] == len(ids)
        assert g["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert encode_documents(empty, PATH, public_tokenizers.PATTERN).count() == 0
