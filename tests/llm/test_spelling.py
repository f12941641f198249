"""Spelling variants: the gram bounds, the pairs and the query against brute force."""
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadlens.llm import spelling as S


def edits(word, letters):
    out = set()
    for i in range(len(word) + 1):
        out |= {word[:i] + c + word[i:] for c in letters}
        if i < len(word):
            out.add(word[:i] + word[i + 1:])
            out |= {word[:i] + c + word[i + 1:] for c in letters}
    return out - {word}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, every=97, least=3):
    n = Counter()
    for key, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % every == 0 else run] += 1
    n = {w: c for w, c in n.items() if c >= least and len(w) >= 5}
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]]))
    return sorted(out)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", min_size=5, max_size=11), min_size=5, max_size=40), st.integers(0, 3), st.integers(1, 4))
def test_unchanged_grams_stay_in_place(words, list_words, rare):
    """Of every word at most ``bound`` grams are missing, at their place, in any word one edit away."""
    counts = Counter(f"^{w}$"[i:i + k] for w in words for k in (2, 3, 4) for i in range(len(w) + 3 - k))
    grams = S.Grams({g: c for g, c in counts.items() if c >= rare}, list_words)

    def placed(w):
        x = f"^{w}$"
        return [(x[a:b + 1], a) for a, b in zip(*grams.cut(x))]

    for w in words[:3]:
        x = f"^{w}$"
        own = placed(w)
        bound = grams.bound(x, *grams.cut(x))
        for other in edits(w, "abd"):
            there, shift = set(placed(other)), len(other) - len(w)
            same = sum((g, a) in there or (g, a + shift) in there for g, a in own)
            assert same >= len(own) - bound


def test_plain_grams_always_leave_some():
    rng = random.Random(1)
    for _ in range(200):
        x = "^" + "".join(rng.choice("abé") for _ in range(rng.randint(5, 15))) + "$"
        assert S.Grams({}).rarest(x)[1]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    stems = ["".join(rng.choice(["ba", "na", "ta", "lé", "o", "rin", "st", "ß"]) for _ in range(rng.randint(3, 5))) for _ in range(120)]
    words = list(stems)
    for s in stems:
        words += rng.sample(sorted(edits(s, "abéÿ")), 4)
    words += ["×÷×÷×", "aaaaa", "aaaaaa", "aaaaaaa", "aaaab", "Überall", "überall", "Überalle", "abc", "日本語日本語"]
    rows = [(rng.choice([None, 1, 2, i]), " ".join(rng.choices(words, weights=[1 + (i % 9) ** 2 for i in range(len(words))], k=60)))
            for i in range(150)]
    return rows + [(7, None), (8, ""), (9, "12 ... 語"), (10, "aaaaa " * 3000)] + [rows[0]] * 3


@pytest.mark.parametrize("list_words,rare", [(300, 20), (5, 2), (0, 1)])
def test_variants_are_the_rule(make_docs, rows, monkeypatch, list_words, rare):
    monkeypatch.setattr(S.Grams.__init__, "__defaults__", (list_words,))
    monkeypatch.setattr(S.common_grams, "__defaults__", (rare, S.DICTIONARY))
    df = make_docs([t for _, t in rows], [k for k, _ in rows])
    got = sorted(tuple(r) for r in S.variants(df, every=7).collect())
    assert got == brute(rows, every=7)
    assert any(r[1] for r in got) and any(r[2] not in (r[0], r[1]) for r in got)


def test_dictionary_stays_bounded(make_docs, rows):
    words = S.word_counts(make_docs([t for _, t in rows], [k for k, _ in rows]).selectExpr("doc_id AS id", "text"))
    assert len(S.common_grams(words, 1, 50)) <= 50


def test_empty_table(make_docs):
    assert S.variants(make_docs(["x"]).limit(0)).collect() == []
    assert S.variants(make_docs([None, "", "a b"])).collect() == []
