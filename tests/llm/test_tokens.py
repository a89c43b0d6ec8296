"""Token counts and byte-level BPE against the public libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from conftest_llm import ODD
from tokenizers import Tokenizer

from codeloom.llm import byte_bpe, token_counts
from codeloom.llm.common import pieces

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def random_texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    letters = [chr(c) for c in [*range(0x20, 0x250), *range(0x370, 0x400), *range(0x4E00, 0x4E40), 9, 10, 0x1F600, 0x300, 0x301, 0x3000]]
    ascii_ = "ab cd  \n\n\t's 're 12.,!|"
    return ["".join(rng.choice(letters if i % 2 else ascii_) for _ in range(rng.randrange(80))) for i in range(n)]


TEXTS = [*ODD, *random_texts(1, 400), "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "IT'S it'll 123 ab12", "a" * 5_000 + " b " * 3_000]


def test_byte_bpe_agrees_with_the_library_and_round_trips(documents):
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={}
    )
    encoded = byte_bpe.decode(byte_bpe.encode(documents(TEXTS), RANKS, public_tokenizers.PATTERN), RANKS)
    for row in encoded.collect():
        text = TEXTS[row.doc_id] or ""
        assert np.frombuffer(row.ids, "<u4").tolist() == library.encode_ordinary(text)
        assert bytes(row.decoded).decode() == text
    again = byte_bpe.round_trip(documents(TEXTS), RANKS, public_tokenizers.PATTERN)
    assert sorted(again.collect()) == sorted(encoded.collect())
    digest = byte_bpe.digests(encoded).where("doc_id = 0").first()
    nothing = hashlib.sha256(b"").hexdigest()
    assert (digest.n_tokens, digest.ids_sha256, digest.decoded_sha256) == (0, nothing, nothing)


def test_byte_bpe_of_no_rows(documents):
    assert byte_bpe.encode(documents([]), RANKS, public_tokenizers.PATTERN).count() == 0


def test_rank_queue_gives_ranks_then_positions_in_order():
    queue, rng = byte_bpe.RankQueue(50_000), random.Random(4)
    entries = [(rng.choice((3, 255, 256, 49_999, rng.randrange(50_000))), rng.randrange(1_000)) for _ in range(2_000)]
    for entry in entries:
        queue.push(*entry)
    taken = []
    while queue.root:
        taken.append(queue.pop())
    assert taken == sorted(entries)


def test_lower_ranks_that_a_merge_makes_come_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 257, b"ab": 258, b"cd": 259}
    assert byte_bpe.ByteBPE(ranks, ".+").merged(b"abcabcd") == [256, 256, ord("d")]


def test_pieces_cut_only_between_words():
    for text in TEXTS:
        assert "".join(pieces(text or "", 50)) == (text or "")
        assert byte_bpe.ByteBPE({}, public_tokenizers.PATTERN).findall(text or "") == [
            m for piece in pieces(text or "", 50) for m in byte_bpe.ByteBPE({}, public_tokenizers.PATTERN).findall(piece)
        ]


def test_token_counts_agree_with_the_library(documents):
    library = Tokenizer.from_file(WORDS)
    for row in token_counts.token_counts(documents(TEXTS), WORDS).collect():
        text = TEXTS[row.doc_id] or ""
        expected = len(library.encode(text, add_special_tokens=False).ids)
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), expected, expected > 2048)


def test_chunk_maps_compose_to_the_whole():
    counter = token_counts.TokenCounter(WORDS)
    for text in TEXTS:
        assert len({counter.text(text or "", size) for size in (5, 17, 1 << 16)}) == 1
