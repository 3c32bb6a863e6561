"""The encoder as a transducer: segments, long pre-tokens, and what it holds."""

import random
import tracemalloc

import pytest
from tokenizers import Tokenizer

from jobscope.llm import bpe

PIECES = ["'re", "'", "r", "e", " ", "  ", "\n", "a", "aaaa", "th", "ing", "é", "中", "1", "42", "!!", "\u3000", "'ll", "<|endoftext|>", "🙂"]


@pytest.fixture(scope="module")
def own():
    return bpe.load(bpe.vocabulary_path())


def test_forward_equals_merging_by_rank(own):
    random.seed(11)
    for letters in (b"ab", b"abcdeinorst", bytes(range(256))):
        for _ in range(300):
            data = bytes(random.choices(letters, k=random.randint(1, 90)))
            assert own.forward(data) == own.merge_all(data)


@pytest.mark.parametrize("segment", [7, 50, 65_536])
def test_segments_of_any_size_give_the_librarys_ids(own, monkeypatch, segment):
    monkeypatch.setattr(bpe, "SEGMENT", segment)
    library = Tokenizer.from_file(bpe.vocabulary_path())
    random.seed(segment)
    for _ in range(150):
        text = "".join(random.choices(PIECES, k=random.randint(0, 250)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize(
    ("text", "most"),
    [("abc " * 2_500_000, 12), ("xq" * 500_000, 12), (" " * 1_500_000, 12), ("中" * 500_000, 12)],
    ids=["words", "letters", "blanks", "ideographs"],
)
def test_memory_does_not_follow_the_text(own, text, most):
    sum(c[0] for some in own.chunked(text[:1000]) for c in some)
    tracemalloc.start()
    n = sum(len(part) for part in bpe.text_of(b"".join(c[2] for c in some) for some in own.chunked(text)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Besides caches: a segment and its parts; of one long pre-token, that pre-token and its bytes.
    assert n == len(text) and peak < most * 1_000_000
