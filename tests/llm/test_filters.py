"""Quality rules, URL filter, classifier, sanitisation and transcripts."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import ODD

from codeloom.llm import chat_turns, quality_gam, quality_rules, sanitise, url_filter


def plain_counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, covered, seen, again = Counter(windows), set(), set(), 0
    for i, window in enumerate(windows):
        if often[window] > 1:
            covered.update(range(i, i + 8))
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_quality_counts_agree_with_a_plain_version(documents):
    rng = random.Random(6)
    texts = list(ODD)
    for _ in range(60):
        words = [rng.choice("abcdef|#") * rng.randrange(1, 4) for _ in range(rng.randrange(60))]
        texts.append("".join(w + rng.choice((" ", "\n", "  ", "\t")) for w in words * rng.randrange(1, 3)))
    found = {r.doc_id: r for r in quality_rules.quality_verdicts(documents(texts)).collect()}
    assert len(found) == len(texts)
    for doc, text in enumerate(texts):
        r, plain = found[doc], plain_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain
        assert r.base_failed == (plain[0] < 20 or 100 * plain[4] > 30 * plain[0])
        assert not (r.kept and r.base_failed)
    assert quality_rules.quality_verdicts(documents([])).count() == 0


def test_thresholds_follow_language_and_source(spark):
    def text(length: int, i: int) -> str:
        return " ".join(chr(97 + (i * 7 + k * k) % 26) * length + str(k) for k in range(40))

    # Long words are usual in one source and strange in the other; a small source leans on its language.
    rows = [(i, text(4, i), "en", "short") for i in range(150)] + [(200 + i, text(30, i), "en", "long") for i in range(150)]
    rows += [(900, text(30, 1), "en", "short"), (901, text(4, 2), "en", "long"), (902, text(4, 3), None, None)]
    verdicts = quality_rules.quality_verdicts(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"))
    kept = {r.doc_id: r.kept for r in verdicts.collect()}
    assert not kept[900] and not kept[901] and kept[902]
    assert sum(kept.values()) == 301


def test_sketch_buckets_hold_a_thirty_second(spark):
    values = spark.range(0, 100_000, 7).select("id", quality_rules.bucket("id").alias("low"))
    assert values.where("low > id OR id - low > id / 32").count() == 0
    assert values.where("id < 64 AND low <> id").count() == 0


def plain_glob(glob: str, text: str) -> bool:
    parts = re.split(r"(\*\*|\*|\?)", glob)
    of = {"**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}
    return re.fullmatch("".join(of.get(p, re.escape(p)) for p in parts), text) is not None


def test_automaton_agrees_with_regular_expressions():
    rng = random.Random(7)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "**", "?"]) for _ in range(rng.randrange(1, 30))) for _ in range(60)] + ["", "**"]
    texts = ["".join(rng.choice("aab/") for _ in range(rng.randrange(12))) for _ in range(300)]
    found = url_filter.ShiftAnd(globs).matches([t.encode() for t in texts])
    for i, text in enumerate(texts):
        assert [bool(f) for f in found[i]] == [plain_glob(g, text) for g in globs]


def test_url_verdicts(spark):
    urls = {
        "https://A.Example.ORG/es/1?q": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "http://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://xexample.org/es/": ("xexample.org", "/es/", "org/", "allow"),
        "http://a.com/fr/x#y": ("a.com", "/fr/x", "com/fr/", "allow"),
        "http://a.com/de/": ("a.com", "/de/", "com/de/", "block"),
        "http://a.com/x/a.org/": ("a.com", "/x/a.org/", None, "allow"),
        "http://a.com": ("a.com", "", None, "allow"),
        "http://org": ("org", "", None, "allow"),
        "http://a.net/wp-admin/x": ("a.net", "/wp-admin/x", None, "block"),
        "no scheme": ("", "", None, "block"),
        "x://://y": (":", "//y", None, "allow"),
        "": ("", "", None, "block"),
        None: ("", "", None, "block"),
    }
    rows = [(i, u, "h", "r") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, rule string")
    found = sorted(url_filter.url_verdicts(pages).collect())
    assert [tuple(r)[1:] for r in found] == list(urls.values())
    assert url_filter.url_verdicts(pages.limit(0)).count() == 0


def test_classifier_learns_and_scores_everything(documents, spark):
    rng = random.Random(8)
    texts = list(ODD)
    for i in range(400):
        words = [rng.choice(("alpha", "beta", "gamma", "delta", "x")) for _ in range(rng.randrange(5, 80))]
        texts.append(" ".join(words) if i % 2 else "### ".join(words).upper())
    n = len(ODD)
    labels = spark.createDataFrame([(n + i, i % 2) for i in range(400)] + [(None, 1), (2, None)], "doc_id bigint, quality int")
    found = sorted(quality_gam.quality_scores(documents(texts), labels).collect())
    assert [r.doc_id for r in found] == list(range(len(texts)))
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    held = [r for r in found[n:] if r.held_out]
    assert held and all(r.predicted == (r.doc_id - n) % 2 for r in held)
    none = quality_gam.quality_scores(documents(texts[:12]), labels.limit(0)).collect()
    assert all(r.score == 0.5 for r in none)
    assert quality_gam.quality_scores(documents([]), labels).count() == 0


def test_pairs_are_learnt():
    rng = np.random.default_rng(1)
    x = rng.random((4_000, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    score = quality_gam.fit(x, y).score(x)
    assert ((score > 0.5) == y).mean() > 0.9


def plain_spans(text: str) -> list:
    def digits(s: str) -> str:
        return re.sub("[^0-9]", "", s)

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 13 <= len(digits(m[0])) <= 19 and sanitise.passes_luhn(digits(m[0])):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return out


def test_identifiers_agree_with_the_plain_patterns():
    rng = random.Random(9)
    texts = ["".join(rng.choice("aB1.@- +()%_é29 ") for _ in range(rng.randrange(80))) for _ in range(5_000)]
    texts += ["4111 1111-1111 1111", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "000000001.2.3.4", "+1 (234) 567-890. ", "x@y"]
    for text in texts:
        assert sanitise.base_spans(text) == plain_spans(text)
    sanitise.base_spans("1" * 200_000 + "." * 1_000 + "a" * 200_000 + "@")  # linear
    assert sanitise.passes_luhn("4111111111111111") and not sanitise.passes_luhn("4111111111111112")


def test_disclosing_terms_go(documents):
    filler = [f"ordinary words about thing number {chr(97 + i % 26) * 5} and weather" for i in range(1_500)]
    texts = [*ODD, *filler]
    for i in range(4):
        texts.append(f"talk {chr(97 + i) * 6} with Quillon please quillon.x@mail.example.com about weather {i}")
    texts += ["Quillon was here", "weather was here"]
    rows = {r.doc_id: r for r in sanitise.span_digest(sanitise.personal_spans(documents(texts))).collect()}
    assert len(rows) == len(texts)
    assert rows[len(texts) - 2].spans == "term:0:7" and rows[len(texts) - 1].spans == ""
    assert [rows[i].n_email for i in (0, 1, len(texts) - 3)] == [0, 0, 1]
    clean = {r.doc_id: r for r in sanitise.sanitised(documents(texts)).collect()}
    assert clean[len(texts) - 2].text == "[NAME] was here"
    assert "[EMAIL]" in clean[len(texts) - 3].text and "quillon" not in clean[len(texts) - 3].text.lower()
    assert [clean[i].text for i in range(len(ODD))] == ODD and clean[0].n_words == 1
    assert sanitise.personal_spans(documents([])).count() == 0


@pytest.fixture(scope="module")
def conversations(spark):
    rng = random.Random(10)
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 7)):
            user = t % 2 == 0
            text = "why so? " * rng.randrange(1, 4) if user else "because\nof this\n" * rng.randrange(2, 9)
            rows.append((c, t, "user" if user else "assistant", text.strip()))
    rows += [(7, 50 + t, "human" if t % 2 == 0 else "gpt", "Why?" if t % 2 == 0 else "line\n" * 9) for t in range(300)]
    rows += [(None, None, None, None), (61, 0, "narrator", ""), (61, 0, "user", "same"), (61, 0, "user", "same")]
    rows += [(62, 0, None, "User: is it?\nAssistant: it is\n### Human:\nsure?")]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_turns_agree_with_an_unbroken_path(conversations, spark):
    weights = chat_turns.weights_of(chat_turns.segment_rows(conversations))
    found = chat_turns.chat_turns(conversations).orderBy("place").collect()
    assert len(found) == conversations.count() + 2
    by: dict = {}
    for r in found:
        by.setdefault(r.conv_id, []).append(r)
    texts = {(r.conv_id, r.turn, s): chat_turns.seen(m, b) for r in conversations.collect() for s, (m, b) in enumerate(chat_turns.segments(r.text or ""))}
    for conversation, rows in by.items():
        if conversation == 61:
            continue
        states = chat_turns.path(weights, [texts[r.conv_id, r.turn, r.segment] for r in rows], None, None)
        assert [r.role for r in rows] == [chat_turns.ROLES[s] for s in states]
        assert [r.opens for r in rows] == [i == 0 or rows[i - 1].role != r.role for i, r in enumerate(rows)]
    assert [r.role for r in by[62]] == ["user", "assistant", "user"]
    assert by[62][1].rendered == "<|assistant|>\nit is"
    known = {(r.conv_id, r.turn): r.role for r in conversations.where("conv_id < 60").collect()}
    right = [chat_turns.NAMES[known[r.conv_id, r.turn]] == chat_turns.ROLES.index(r.role) for r in found if (r.conv_id, r.turn) in known]
    assert np.mean(right) > 0.95
    assert chat_turns.chat_turns(conversations.limit(0)).count() == 0


def test_markers():
    text = "User: hi\nAssistant: hello\nthere\n### Human:\nok\n<|im_start|>assistant\nfine<|im_end|>\n[USER] x\nAnswer me: no"
    assert chat_turns.segments(text) == [(2, "hi"), (3, "hello\nthere"), (2, "ok"), (3, "fine"), (2, "x\nAnswer me: no")]
    assert chat_turns.segments("") == [(0, "")]


def test_quality_counts_do_not_overflow_on_long_texts(documents):
    words = " ".join(f"w{i}" for i in range(30))
    texts = [words + " " + "#" * 3_000_000, words + " " + "a" * 22_000_000, words + "\n" + (words + "\n") * 100_000]
    found = {r.doc_id: r for r in quality_rules.quality_verdicts(documents(texts)).collect()}
    assert found[0].n_symbols == 3_000_000 and found[1].word_chars == 22_000_000 + sum(len(f"w{i}") for i in range(30))
    assert found[2].n_dup_lines == 100_000 and found[2].base_failed


def test_turns_bear_long_blank_texts_and_the_largest_turn(conversations, spark):
    import time

    begun = time.perf_counter()
    assert chat_turns.seen(0, "a" + "\n" * 200_000 + "b")[4] == 0
    assert chat_turns.seen(0, "a\n\n \t- b")[4] == 1
    assert time.perf_counter() - begun < 1
    last = (1 << 63) - 1
    extra = spark.createDataFrame(
        [(90, last - 1, "user", "why?"), (90, last, "assistant", "because\n" * 3), (91, 0, None, "\n" * 20_000)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    rows = chat_turns.chat_turns(conversations.unionByName(extra)).collect()
    assert {r.turn for r in rows if r.conv_id == 90} == {last - 1, last}
    assert any(r.conv_id == 91 for r in rows)


def test_many_identifiers_in_one_text_cost_linear_time():
    import time

    text = " ".join(f"mail to person{i}@example.org about Kim" for i in range(20_000))
    spans = sanitise.base_spans(text)
    begun = time.perf_counter()
    pairs = sanitise.nearby(text, spans)
    assert time.perf_counter() - begun < 10
    small = " ".join(f"mail to person{i}@example.org about Kim +1 555 010 {i:04d}" for i in range(30))
    found = sanitise.base_spans(small)
    assert sanitise.nearby(small, found[::-1]) == sanitise.nearby(small, found)  # the order of spans does not matter
    assert len(spans) == 20_000 and len(pairs) >= 20_000
