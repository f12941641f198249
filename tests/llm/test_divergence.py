"""Source divergence against the rule spelled out term by term."""
import random
import re
from collections import Counter, defaultdict

import pytest

from threadlens.llm import divergence

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, min_docs, top, scale):
    docs = [(lang or "", source or "", TERM.findall(lowered(text or ""))) for text, lang, source in rows]
    count, total, df = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        count[lang, source].update(words)
        total[lang].update(words)
        df[lang].update(set(words))
    out = []
    for lang in {d[0] for d in docs}:
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        v = len(kept)

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + scale * (c[t] + 2) // (n + 2 * v) for t in kept}

        q = shares(total[lang])
        p = {s: shares(count[l, s]) for l, s in count if l == lang}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in p if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(items[:most])]
    return sorted(out)


@pytest.mark.parametrize("seed,min_docs,top,scale", [(1, 3, 10, 10 ** 9), (2, 2, 4, 1000), (3, 1, 3, 10 ** 9), (4, 50, 10, 10 ** 9)])
def test_audit_is_the_rule(spark, make_docs, seed, min_docs, top, scale):
    rng = random.Random(seed)
    words = ["the", "The", "THE", "über", "Über", "naïve", "x1y", "don't", "語", "a\u0080b", "é", "\U0001f600", "zz", "y" * 50]
    words += ["".join(rng.choice("abcäé") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    rows = []
    for _ in range(160):
        text = rng.choice([None, "", " 12 _ "] + [None] * 0 + [" ".join(rng.choices(words, k=rng.choice([1, 3, 40, 400])))] * 9)
        rows.append((text, rng.choice(["en", "en", "en", "de", None, ""]), rng.choice(["s0", "s0", "s0", "S1", "é", None, "z"])))
    rows += [rows[0]] * 5 + [("alone", "xx", "only"), (None, "yy", "a"), ("", "yy", "b"), ("1 2", "yy", "B")]
    df = make_docs([r[0] for r in rows], langs=[r[1] for r in rows]).drop("source", "lang")
    extra = spark.createDataFrame([(i, r[1], r[2], 1) for i, r in enumerate(rows)], "doc_id long, lang string, source string, p long")
    df = df.join(extra, "doc_id")
    got = sorted(tuple(r) for r in divergence.audit(df, min_docs, top, scale).select(
        "lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute(rows, min_docs, top, scale)


def test_empty_table_and_types(make_docs):
    out = divergence.audit(make_docs(["x"]).limit(0))
    assert out.collect() == []
    assert dict(out.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint",
                                "rank": "int"}


def test_share_is_exact_beyond_64_bits(spark):
    n, c, v = 5 * 10 ** 12, 3 * 10 ** 11, 10 ** 7
    got = spark.createDataFrame([(c, n, v)], "c long, n long, v long").select(divergence.share("c", "n", "v", 10 ** 9)).first()[0]
    assert got == 1 + 10 ** 9 * (c + 2) // (n + 2 * v)
