"""Near-duplicates, repeated passages and decontamination against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from conftest_llm import ODD

from codeloom.llm import components as graph
from codeloom.llm import decontaminate, simhash, suffix_dedup


def lowered(text: str | None) -> str:
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def prose(rng: random.Random, n: int) -> list[str]:
    return [rng.choice(("alpha", "Beta", "gamma,", "delta", "ü", "eps")) + str(rng.randrange(40)) for _ in range(n)]


def plain_fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints: list[int]) -> list[int]:
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


@pytest.mark.parametrize("block", [512, 4])
def test_near_duplicates_agree_with_all_pairs(documents, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SMALL", 3)
    rng = random.Random(2)
    base = prose(rng, 120)
    texts = [*ODD[:7], *(" ".join(prose(rng, rng.randrange(1, 60))) for _ in range(25)), " ".join(base)]
    for _ in range(30):  # a group of near copies
        words = list(base)
        words[rng.randrange(120)] = "changed" + str(rng.randrange(9))
        texts.append(" ".join(words))
    prints = [plain_fingerprint(t) for t in texts]
    found = simhash.near_duplicates(documents(texts)).collect()
    assert {r.doc_id: r.fingerprint for r in found} == {i: f"{p:016x}" for i, p in enumerate(prints)}
    assert [r.component_id for r in sorted(found, key=lambda r: r.doc_id)] == plain_components(prints)
    assert sorted(r.component_id for r in found if r.stays) == sorted({r.component_id for r in found})


def test_near_duplicates_without_ids_and_rows(documents):
    found = simhash.near_duplicates(documents(["a b c", "a b c", "a b c"], [None, 7, None])).collect()
    assert [(r.doc_id, r.component_id, r.stays) for r in sorted(found, key=lambda r: r.doc_id or 0)] == [
        (None, 7, False), (None, 7, False), (7, 7, True),
    ]
    assert simhash.near_duplicates(documents([])).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 301), (5, 5)]
    found = dict(graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {300: 300, 301: 300}


def plain_passages(texts: list[str | None]) -> set[tuple[int, int, int]]:
    words = [lowered(t).encode().split() for t in texts]
    n = suffix_dedup.LEAST
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = set()
    for doc, w in enumerate(words):
        starts = [i for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1]
        while starts:
            end = begin = starts.pop(0)
            while starts and starts[0] - end <= n:
                end = starts.pop(0)
            out.add((doc, begin, end + n - begin))
    return out


def test_passages_agree_with_all_windows(documents):
    rng = random.Random(3)
    shared = [prose(rng, n) for n in (49, 50, 51, 90, 200)]
    texts = [*ODD]
    for i in range(40):
        words = prose(rng, rng.randrange(0, 80))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(shared)
        texts.append(("  " if i % 2 else "\n").join(words))
    texts += [texts[-1], texts[-1].upper(), " ".join(shared[4]), " ".join(shared[4])]
    found = suffix_dedup.passages(documents(texts)).collect()
    assert {(r.doc_id, r.begin, r.n_words) for r in found} == plain_passages(texts)
    assert len(found) == len({(r.doc_id, r.begin) for r in found})
    assert all(r.first_doc_id <= r.doc_id for r in found)
    assert suffix_dedup.passages(documents([])).count() == 0


def left_after_cutting(rows, texts: list, ids: list) -> tuple[dict, Counter, dict]:
    """The places of each repeated window, how often it is left when the ``cuts`` are cut, and the words cut."""
    n = suffix_dedup.LEAST
    cut = defaultdict(set)
    for r in rows:
        assert all(r.begin <= c["begin"] and c["begin"] + c["n_words"] <= r.begin + r.n_words for c in r.cuts)
        cut[r.doc_id].update(i for c in r.cuts for i in range(c["begin"], c["begin"] + c["n_words"]))
    places = defaultdict(list)
    for doc, text in zip(ids, texts, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
        for i in range(len(w) - n + 1):
            places[tuple(w[i : i + n])].append((doc, i))
    places = {w: sorted(p) for w, p in places.items() if len(p) > 1}
    return places, Counter({w: sum(cut[d].isdisjoint(range(i, i + n)) for d, i in p) for w, p in places.items()}), cut


def test_every_repeated_window_stays_once_after_cutting(documents):
    rng = random.Random(11)
    p1, p2, p3, p4 = (prose(rng, n) for n in (120, 130, 140, 150))
    own = lambda n: prose(rng, n)
    copied = own(60) + p4 + own(70)
    texts = {
        9: p2, 5: p1 + p2, 1: own(20) + p1 + own(30),  # the first document changes inside one passage
        12: own(10) + p3 + own(10) + p3,  # repeated in one document alone
        11: copied, 10: copied, 2: own(9) + p4,  # a passage of another document in copies
        20: ["x"] * 300,
    }
    ids, texts = list(texts), [" ".join(w) for w in texts.values()]
    rows = suffix_dedup.passages(documents(texts, ids).coalesce(1)).collect()
    places, left, cut = left_after_cutting(rows, texts, ids)
    assert places and set(left.values()) == {1}
    assert cut[5] == set(range(120)) and cut[9] == set(range(130)) and cut[12] == set(range(160, 300))
    assert cut[10] == set(range(60 + 49, 60 + 150 - 49)) and cut[11] == set(range(280)) and cut[20] == set(range(50, 300))
    parts = {r.doc_id: [tuple(p) for p in r.parts] for r in rows}
    assert parts[5] == [(0, 120, 1, 20, False), (120, 130, 5, 120, True)]
    assert parts[10] == [(0, 109, 10, 0, True), (60, 150, 2, 9, False), (161, 119, 10, 161, True)]


def test_first_place_does_not_depend_on_the_order_of_rows(documents):
    rng = random.Random(12)
    shared = prose(rng, 80)
    copied = " ".join(prose(rng, 30) + shared)
    texts, ids = [copied, copied, " ".join(shared + prose(rng, 20))], [7, 3, 5]
    for order in ((0, 1, 2), (1, 0, 2), (2, 0, 1)):
        rows = suffix_dedup.passages(documents([texts[i] for i in order], [ids[i] for i in order]).coalesce(1)).collect()
        assert {r.doc_id: (r.first_doc_id, [tuple(c) for c in r.cuts]) for r in rows} == {
            3: (3, []), 5: (3, [(0, 80)]), 7: (3, [(0, 110)]),
        }


def test_cutting_loses_no_repeated_window(documents):
    rng = random.Random(13)
    shared = [prose(rng, n) for n in (50, 51, 75, 110)]
    texts = []
    for _ in range(40):
        pieces = [prose(rng, rng.randrange(30)) if rng.randrange(3) else rng.choice(shared)[rng.randrange(9) :] for _ in range(6)]
        texts.append(" ".join(w for piece in pieces for w in piece))
    texts += texts[:6] + [t.upper() for t in texts[4:8]]
    ids = list(range(-20, len(texts) - 20))
    ids[3], ids[7] = (1 << 63) - 1, -1 << 63
    rng.shuffle(ids)
    rows = suffix_dedup.passages(documents(texts, ids).repartition(3)).collect()
    places, left, cut = left_after_cutting(rows, texts, ids)
    n = suffix_dedup.LEAST
    kept = defaultdict(set)
    for first, *_ in places.values():
        assert cut[first[0]].isdisjoint(range(first[1], first[1] + n))
        kept[first[0]].update(range(first[1], first[1] + n))
    for first, *others in places.values():
        for doc, i in others:
            assert not cut[doc].isdisjoint(range(i, i + n)) or kept[doc].issuperset(range(i, i + n))
    assert {(r.doc_id, p["begin"]) for r in rows for p in r.parts if p["stays"]} <= {p[0] for p in places.values()}


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def test_contamination_agrees_with_all_windows(documents, spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, " ".join(prose(rng, n))) for i, n in enumerate((30, 12, 10, 9, 3, 1, 14))]
    items += [(3, items[1][1]), (20, None), (21, ""), (22, "?!"), (None, items[6][1]), (8, items[0][1])]
    texts = [*ODD]
    for i in range(30):
        words = prose(rng, rng.randrange(30))
        piece = rng.choice(items)[1] or ""
        words[3:3] = piece.split()[rng.randrange(3) :]
        texts.append((" - " if i % 2 else "\t").join(words).upper() if i % 3 else " ".join(words))
    windows = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(item)
    table = spark.createDataFrame(items, "item_id bigint, text string")
    for shard in (1 << 20, 100):
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
        rows = decontaminate.contamination(documents(texts), table)
        found = {r.doc_id: r for r in decontaminate.contamination_digest(rows).collect()}
        assert len(found) == len(texts)
        for doc, text in enumerate(texts):
            w, hit, ids = words_of(text), set(), set()
            for window, of in windows.items():
                for i in range(len(w) - len(window) + 1):
                    if tuple(w[i : i + len(window)]) == window:
                        hit.update(range(i, i + len(window)))
                        ids |= of
            names = sorted(str(i) for i in ids if i is not None)
            digest = hashlib.sha256(",".join(names).encode()).hexdigest()
            r = found[doc]
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(names), digest, bool(hit))
        for r in rows.where("size(hits) > 0").collect():
            inside = {i for s in r.spans for i, m in enumerate(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(texts[r.doc_id])))
                      if s["begin"] <= m.start() and m.end() <= s["end"]}
            assert inside == set(r.hits)
    assert decontaminate.contamination(documents(texts), table.limit(0)).where("size(hits) > 0").count() == 0
