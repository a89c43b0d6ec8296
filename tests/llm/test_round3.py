"""Exact duplicates, spelling variants and token alignment against plain versions."""

import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
from conftest_llm import ODD
from sentencepiece import sentencepiece_model_pb2

from codeloom.llm import exact_dedup, spelling_variants, token_alignment


def lowered(text: str | None) -> str:
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


# ---------------------------------------------------------------- exact duplicates


def plain_exact(rows: list[tuple[int | None, str | None]]) -> dict:
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[lowered(text)].append(doc_id)
    out = []
    for doc_id, text in rows:
        members = groups[lowered(text)]
        ids = [i for i in members if i is not None]
        keep = max(ids) if ids else None
        out.append((doc_id, keep, len(members), doc_id == keep, hashlib.sha256(lowered(text).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("head", [exact_dedup.HEAD_CHARS, 2])
def test_exact_duplicates_match_plain_groups(documents, monkeypatch, head):
    monkeypatch.setattr(exact_dedup, "HEAD_CHARS", head)
    texts = [*ODD, "Hello World", "hello world", "HELLO WORLD", "hello worle", "héllo world", "Héllo world", "ab", "ac", "ab"]
    ids = [*range(len(texts) - 1), 3]  # a repeated id, and repeated rows
    rows = list(zip(ids, texts, strict=True))
    got = exact_dedup.exact_duplicates(documents(texts, ids), digest_all=True).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_exact(rows)


def test_exact_duplicates_hash_only_open_rows(documents):
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(documents(["aaa", "bbbb", "AAA", "ccccc", "cccca"])).collect()}
    assert got[1].text_hash is None and got[3].text_hash is None  # alone by length, alone by head
    assert got[0].text_hash == got[2].text_hash and got[0].keep_id == 2 and not got[0].kept and got[2].kept


def test_exact_duplicates_without_the_broadcast(documents, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_KEYS", 0)
    texts = ["x", "X", "y", "zz", None, ""]
    got = exact_dedup.exact_duplicates(documents(texts), digest_all=True).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_exact(list(enumerate(texts)))


def test_exact_duplicates_of_nothing(documents):
    assert exact_dedup.exact_duplicates(documents([]).where("false")).count() == 0


def test_exact_duplicates_null_ids(spark):
    rows = spark.createDataFrame([(None, "a"), (None, "A"), (5, "b"), (None, "b")], "doc_id long, text string")
    got = sorted((tuple(r)[:4] for r in exact_dedup.exact_duplicates(rows).collect()), key=repr)
    assert got == sorted([(None, None, 2, True), (None, None, 2, True), (5, 5, 2, True), (None, 5, 2, False)], key=repr)


# ---------------------------------------------------------------- spelling variants


def plain_words(rows: list[tuple[int | None, str | None]]) -> Counter:
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            if doc_id is not None:
                h = zlib.crc32(f"{doc_id}:{run}".encode())
                if h % 31 == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
            seen[run] += 1
    return Counter({w: n for w, n in seen.items() if len(w) >= 7 and n >= 2})


def plain_near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows: list) -> list[tuple]:
    n = plain_words(rows)
    near = {w: [v for v in n if plain_near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def variant_texts() -> list[str]:
    base = ["reception", "recepcion", "receptian", "receptions", "recption", "receptionist", "Éléphantin", "éléphantin"]
    texts = []
    for k in range(40):
        texts.append(" ".join(["reception"] * 3 + ["elephantine", "Elephantine"] + [base[k % len(base)]] * 2))
    texts += ["recepcion recepcion receptian", "recepcions recepcions", "elephantines elephantines", *ODD]
    return texts


def test_variants_match_plain_search(documents):
    texts = variant_texts()
    got = spelling_variants.variants(documents(texts)).collect()
    assert sorted(tuple(r) for r in got) == plain_variants(list(enumerate(texts)))


def test_variants_in_many_small_blocks(documents, monkeypatch):
    monkeypatch.setattr(spelling_variants, "INDEX_BLOCK", 3)
    monkeypatch.setattr(spelling_variants, "ASK_BLOCK", 2)
    monkeypatch.setattr(spelling_variants, "LEAF", 1)
    texts = variant_texts()
    got = spelling_variants.variants(documents(texts)).collect()
    assert sorted(tuple(r) for r in got) == plain_variants(list(enumerate(texts)))


def test_near_pairs_against_all_pairs():
    import random

    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randrange(7, 10))) for _ in range(400)})
    for length in range(7, 10):
        same = [w for w in words if len(w) == length]
        longer = [w for w in words if len(w) == length + 1]
        want = {(a, b) for a in same for b in same if a < b and plain_near(a, b)}
        want |= {(a, b) for a in same for b in longer if plain_near(a, b)}
        got = set(spelling_variants.near_pairs(same, same)) | set(spelling_variants.near_pairs(same, longer))
        assert got == want
    assert set(spelling_variants.near_pairs(words, words)) == {
        (a, b) for a in words for b in words if (len(a) < len(b) or (len(a) == len(b) and a < b)) and plain_near(a, b)
    }


def test_variants_of_nothing(documents):
    assert spelling_variants.variants(documents([None, "", "short words only"])).count() == 0


# ---------------------------------------------------------------- token alignment


@pytest.fixture(scope="module")
def encoders():
    return token_alignment.Encoders(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def plain_alignment(enc, text: str | None) -> tuple:
    text = text or ""
    a_ids, b_ids = (x[0] for x in enc.ids([text]))
    a = [enc.a_bytes[i] for i in a_ids]
    b = [enc.b_bytes[i] for i in b_ids]
    whole = (" " + text).encode()
    if not text or b"".join(a) != whole or b"".join(b) != whole:
        return 0, 0, 0, "", Counter()

    def spans(parts):
        out, at = [], 0
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    sa, sb = spans(a), spans(b)
    cuts = sorted({e for _, e in sa} & {e for _, e in sb})
    groups, begin = [], 0
    for cut in cuts:
        xs = [str(i) for i, (s, e) in zip(a_ids, sa) if begin <= s < cut]
        ys = [str(i) for i, (s, e) in zip(b_ids, sb) if begin <= s < cut]
        groups.append(f"{','.join(xs)}|{','.join(ys)}")
        begin = cut
    links = Counter(
        (ia, ib) for ia, (s1, e1) in zip(a_ids, sa) for ib, (s2, e2) in zip(b_ids, sb) if s1 < e2 and s2 < e1
    )
    return len(a_ids), len(b_ids), len(cuts), ";".join(groups), links


ALIGN_TEXTS = [
    *ODD[:7],
    "Hello <|endoftext|> world <s>",
    "naïve café — 東京 \U0001f600 done",
    "  two  spaces\n\nand lines\t",
    "Hello <|endoftext|> world <s>",
    "x" * 3000,
]


def test_align_matches_all_overlapping_pairs(encoders):
    for text in ALIGN_TEXTS:
        a_ids, b_ids = (x[0] for x in encoders.ids([text or ""]))
        n_a, n_b, n_groups, groups, a, b, n = token_alignment.align(text or "", encoders, a_ids, b_ids)
        links = Counter({(x, y): c for x, y, c in zip(a.tolist(), b.tolist(), n.tolist(), strict=True)})
        assert (n_a, n_b, n_groups, groups, links) == plain_alignment(encoders, text)


def test_alignment_sums_match_plain_counts(documents, encoders):
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    got = {r.doc_id: r for r in token_alignment.alignment(documents(ALIGN_TEXTS), a, b).collect()}
    per_doc = [plain_alignment(encoders, t) for t in ALIGN_TEXTS]
    count = Counter(pair for *_, links in per_doc for pair in links)
    best = defaultdict(int)
    for (x, _), c in count.items():
        best[x] = max(best[x], c)
    assert len(got) == len(ALIGN_TEXTS)
    for i, (n_a, n_b, n_groups, groups, links) in enumerate(per_doc):
        row = got[i]
        assert (row.n_a, row.n_b, row.n_groups, row.groups) == (n_a, n_b, n_groups, groups)
        assert row.n_links == sum(links.values())
        assert row.n_best == sum(n for pair, n in links.items() if count[pair] == best[pair[0]])
        assert row.count_sum == sum(n * count[pair] for pair, n in links.items())
    assert any(r.n_a for r in got.values()) and got[0].n_a == 0


def test_alignment_through_the_join(documents, monkeypatch):
    monkeypatch.setattr(token_alignment, "MOST_PAIRS", 0)
    monkeypatch.setattr(token_alignment, "CHARS_AT_ONCE", 5)
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    via_join = sorted(tuple(r) for r in token_alignment.alignment(documents(ALIGN_TEXTS), a, b).collect())
    monkeypatch.setattr(token_alignment, "MOST_PAIRS", 10**9)
    assert via_join == sorted(tuple(r) for r in token_alignment.alignment(documents(ALIGN_TEXTS), a, b).collect())


def test_alignment_of_nothing(documents):
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    assert token_alignment.alignment(documents([]).where("false"), a, b).count() == 0


def test_exact_duplicates_with_a_hot_group(documents, spark):
    texts = ["same"] * 30 + ["Same"] * 10 + ["other", "OTHER", "third"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        got = exact_dedup.exact_duplicates(documents(texts), digest_all=True).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((tuple(r) for r in got), key=repr) == plain_exact(list(enumerate(texts)))


def test_texts_are_encoded_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(token_alignment, "CHARS_AT_ONCE", 5)
    texts = ["abc", "de", "", "fghijkl", "m", "n"]
    parts = list(token_alignment._parts(texts))
    assert [i for part in parts for i in range(len(texts))[part]] == list(range(len(texts)))
    assert all(sum(map(len, texts[part][:-1])) < 5 for part in parts)
    assert list(token_alignment._parts([])) == []


UNIT_TEXTS = [
    None,
    "",
    " ",
    "one",
    "one two one two, one two.\nOne two  three",
    " leading and trailing ",
    "naïve café é à — 東京 x 東京 y",
    "a\u00a0b c\u2003d \u200be\x1cf \x1d g\u0085 h",
    "half ▁ block▁s ▁x a▁ b",
    "it's o' 's 'll x \t y \r\n z",
    "<s> </s> <|endoftext|> <0x41> 12 345 +6",
    "e\u0301 o\u0308 \u0301 x \U0001f600 y\U0001f600 z",
]


def test_units_give_what_whole_texts_give(encoders, monkeypatch):
    assert encoders.cuts and encoders.cut("one two, é\nx  y z") == ["one", "two,", "é\nx  y", "z"]
    texts = [t or "" for t in [*UNIT_TEXTS, *ALIGN_TEXTS]]
    for remembered in (token_alignment.REMEMBERED, 3, 0):
        monkeypatch.setattr(token_alignment, "REMEMBERED", remembered)
        units = token_alignment.Units(encoders)
        for some in (texts, texts[::-1], texts[3:5], [""], texts):
            got = units.align(some)
            ends = got.sizes.cumsum().tolist()
            for i, text in enumerate(some):
                of_text = slice(ends[i] - int(got.sizes[i]), ends[i])
                links = zip(got.a[of_text].tolist(), got.b[of_text].tolist(), got.n[of_text].tolist(), strict=True)
                links = Counter({(x, y): n for x, y, n in links})
                assert (*got.counts[i].tolist(), got.groups[i], links) == plain_alignment(encoders, text), text
    assert [plain_alignment(encoders, t)[0] > 0 for t in UNIT_TEXTS[7:9]] == [True, False]


def test_words_are_encoded_once(monkeypatch):
    given = {"a": 0, "b": 0}

    class Counted:
        def __init__(self, name, real):
            self.name, self.real = name, real

        def __getattr__(self, method):
            def call(texts, **options):
                given[self.name] += sum(map(len, texts))
                return getattr(self.real, method)(texts, **options)

            return call

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    enc = token_alignment._units(*paths).enc
    monkeypatch.setattr(enc, "a", Counted("a", enc.a))
    monkeypatch.setattr(enc, "b", Counted("b", enc.b))
    texts = [f"apples and pears, or plums {i % 7} times" for i in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    monkeypatch.setattr(token_alignment, "CHARS_AT_ONCE", 10_000)
    sizes = [rows.num_rows for rows in token_alignment._work(*paths)(iter([batch]))]
    assert sum(sizes) == 500 and len(sizes) > 1  # a part's rows leave before the next part
    assert max(given.values()) < 200


def test_texts_stay_whole_where_a_tokenizer_may_join_words(tmp_path):
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    with open(a, encoding="utf-8") as file:
        rules = json.load(file)
    rules["added_tokens"].append(rules["added_tokens"][0] | {"id": 50257, "content": "two words", "special": False})
    (tmp_path / "a.json").write_text(json.dumps(rules), encoding="utf-8")
    assert not token_alignment._words_apart(str(tmp_path / "a.json"), b)

    model = sentencepiece_model_pb2.ModelProto()
    with open(b, "rb") as file:
        model.ParseFromString(file.read())
    model.pieces[1000].piece = "e▁o"
    (tmp_path / "b.model").write_bytes(model.SerializeToString())
    assert not token_alignment._words_apart(a, str(tmp_path / "b.model"))
    enc = token_alignment.Encoders(a, str(tmp_path / "b.model"))
    text = "one two the one of the others, apple or eel"
    assert enc.cut(text) == [text]
    got = token_alignment.Units(enc).align([text, "one", text])
    n_a, n_b, n_groups, groups, links = plain_alignment(enc, text)
    assert n_a and got.counts[2].tolist() == [n_a, n_b, n_groups] and got.groups[0] == groups and got.groups[2] == groups
    assert got.n[: got.sizes[0]].sum() == sum(links.values())
