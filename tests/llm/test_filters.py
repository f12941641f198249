"""Words, quality rules, secrets and language ID."""

import base64
import hashlib
import json
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
import pyarrow as pa

from threadlens.llm import langid, quality, secrets
from threadlens.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_and_hashes(edge_texts):
    w = W.split_words(pa.array(edge_texts, pa.string()))
    for i, t in enumerate(edge_texts):
        got = [w.word(j).decode() for j in range(w.first[i], w.first[i + 1])]
        assert got == WORD.findall(t or "")
    h, low = w.hashes(), w.hashes(lower=True)
    every = [x for t in edge_texts for x in WORD.findall(t or "")]
    assert len(set(zip(h.tolist(), every))) == len(set(h.tolist())) == len(set(every))
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in every]
    assert len(set(zip(low.tolist(), lower))) == len(set(low.tolist())) == len(set(lower))
    parts = [W.split_words(pa.array(edge_texts, pa.string()).slice(a, b - a)).hashes()
             for a, b in W.slices(pa.array(edge_texts, pa.string()), 64)]
    assert np.array_equal(np.concatenate(parts), h)


def test_quality_matches_sql(make_docs, edge_texts, vocab):
    rng = random.Random(1)
    line = " ".join(rng.choice(vocab) for _ in range(9))
    texts = edge_texts + ["\n".join([line] * 6), "the of and " * 20, "x | y $ z # " * 9, "go go go go " * 9,
                          line + " and " + line + "\n \n" + line]
    docs = make_docs(texts)
    got = {r["doc_id"]: r.asDict() for r in quality.apply_rules(docs).collect()}
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    res = con.execute(quality.oracle())
    names = [d[0] for d in res.description]
    want = {r[0]: dict(zip(names, r)) for r in res.fetchall()}
    assert got == want and len(got) == len(texts)
    assert got[0]["base_failed"] and not got[0]["kept"]


def test_quality_empty_table(make_docs):
    assert quality.apply_rules(make_docs([])).count() == 0


def _tlv(tag, body):
    n = len(body)
    head = bytes([n]) if n < 128 else bytes([0x82]) + struct.pack(">H", n)
    return bytes([tag]) + head + body


def test_secrets(make_docs, edge_texts):
    rng = random.Random(3)
    rsa = _tlv(0x30, _tlv(2, b"\0") + b"".join(_tlv(2, bytes(rng.randrange(1, 256) for _ in range(16))) for _ in range(8)))
    wrong = bytearray(rsa)
    wrong[2] ^= 1                                   # the outer length no longer fits
    ssh = b"openssh-key-v1\0" + struct.pack(">I", 4) + b"none" + struct.pack(">I", 4) + b"none" + struct.pack(">I", 0) \
        + struct.pack(">I", 1) + bytes(40)
    jwt = ".".join(base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
                   for x in ({"alg": "HS256", "typ": "JWT"}, {"sub": "1"})) + ".c2ln"
    fake = "eyJ" + "A" * 20 + ".abc.def"
    b64 = base64.b64encode(rsa).decode()
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(b64[i:i + 64] for i in range(0, len(b64), 64)) + "\n-----END"
    cases = {
        "é password=abcdefgh x": [("assign", 2, 19)],
        "token: secret: abcdefghij": [],            # the short value is eaten by the first match
        'API_KEY" : "abc/+=._-1': [("assign", 0, 22)],
        "AKIA" + "Z" * 11: [], "xAKIA" + "Z" * 12: [("access", 1, 17)],
        "A" + "0f" * 16 + "g": [("hex", 1, 33)],
        "see " + b64 + " end": [("der", 4, 4 + len(b64))],
        base64.b64encode(bytes(wrong)).decode(): [],
        rsa.hex().upper(): [("der", 0, 2 * len(rsa))],
        base64.b64encode(ssh).decode(): [("openssh", 0, len(base64.b64encode(ssh)))],
        "t " + jwt: [("jwt", 2, 2 + len(jwt))], fake: [],
        pem: [("der", pem.index("\n") + 1, pem.rindex("\n"))],
    }
    texts = list(cases) + edge_texts
    rows = {r["doc_id"]: r for r in secrets.scan(make_docs(texts)).collect()}
    for i, (t, spans) in enumerate(cases.items()):
        assert rows[i]["spans"] == secrets.joined(spans), t
        base = [s for s in spans if s[0] in ("assign", "access", "hex")]
        assert rows[i]["base_sha256"] == hashlib.sha256(secrets.joined(base).encode()).hexdigest()
    for i in range(len(cases), len(texts)):
        assert rows[i]["spans"] == "" and rows[i]["n_assign"] == rows[i]["n_hex"] == 0
    assert secrets.scan(make_docs([])).count() == 0


def test_armoured_keys_of_any_length(make_docs):
    """Keys of 0, 1 and 2 bytes modulo 3, in lines, above armour, words and other base64 lines."""
    rng = random.Random(13)
    algorithm = _tlv(0x30, _tlv(6, bytes([42, 134, 72, 206, 61, 2, 1])))
    texts, want = [], []
    for n in (*range(40, 46), *range(107, 113), 700, 701, 702):
        der = _tlv(0x30, _tlv(2, b"\0") + algorithm + _tlv(4, bytes(rng.randrange(256) for _ in range(n))))
        b64 = base64.b64encode(der).decode()
        for width, cut in ((64, "\n"), (76, "\r\n"), (10 ** 6, "\n")):
            body = cut.join(b64[i:i + width] for i in range(0, len(b64), width))
            for above, below in (("-----BEGIN PRIVATE KEY-----" + cut, cut + "-----END PRIVATE KEY-----"),
                                 ("", cut + "word and words"), ("x" * 45 + cut, cut + "x" * 45 + cut + "abc"),
                                 ("", cut + body), ("", "")):
                t = above + body + below
                texts.append(t)
                found = [("der", len(above), len(above) + len(body))]
                if below == cut + body:
                    found.append(("der", len(body) + len(cut), len(t)))
                want.append(found)
    assert len({len(t.split()[0]) % 4 for t in texts}) > 1
    for t, w in zip(texts, want):
        assert [s for s in secrets.confirmed_spans(t) if s[0] == "der"] == w, t
    rows = {r["doc_id"]: r["n_confirmed"] for r in secrets.scan(make_docs(texts[:30])).collect()}
    assert [rows[i] for i in range(30)] == [len(w) for w in want[:30]]


def test_keys_after_names_and_spaced_headers(make_docs):
    """A key after ``NAME=`` or a mark, and a signed header that starts with white space or is after a name."""
    rng = random.Random(17)
    algorithm = _tlv(0x30, _tlv(6, bytes([42, 134, 72, 206, 61, 2, 1])))
    b64 = base64.b64encode(_tlv(0x30, _tlv(2, b"\0") + algorithm + _tlv(4, rng.randbytes(120)))).decode()
    cases = {}
    for before, below in (("PRIVATE_KEY=", ""), ("key=", "\nnext=1"), ("x/", " y"), ("key_", ""), ("a-", ""), ("k==", ""),
                          ("-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----")):
        cases[before + b64 + below] = [("der", len(before), len(before) + len(b64))]
    for head in ('{"alg":"HS256"}', '{ "alg":"HS256"}', '{\n "alg" : "RS256"}', '\n {"alg":"ES256"}', '\t{"alg":"none"}'):
        jwt = base64.urlsafe_b64encode(head.encode()).decode().rstrip("=") + ".e30.c2ln"
        for before, below in (("", ""), ("jwt=", " x"), ("www.example-host-name.", "")):
            cases[before + jwt + below] = [("jwt", len(before), len(before) + len(jwt))]
    cases |= {"see www.example-of-a-host.org.uk": [], base64.b64encode(b'{ "typ":"JWT"}').decode().rstrip("=") + ".a.b": []}
    rows = {r["doc_id"]: r for r in secrets.scan(make_docs(list(cases))).collect()}
    for i, (t, spans) in enumerate(cases.items()):
        assert rows[i]["spans"] == secrets.joined(spans) and rows[i]["n_confirmed"] == len(spans), t


def _tongues(rng, n):
    parts = {"aa": ["tha", "ing", "the", "shi", "wor"], "bb": ["ção", "que", "ñar", "los", "ado"],
             "cc": ["sch", "ung", "der", "ü", "zei"]}
    texts, langs = [], []
    for _ in range(n):
        lang = rng.choice(sorted(parts))
        texts.append(" ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 40))))
        langs.append(lang)
    return texts, langs


def test_language_accuracy_and_edges(make_docs, edge_texts):
    texts, langs = _tongues(random.Random(4), 400)
    mixed = texts[langs.index("aa")] + " " + texts[langs.index("cc")] * 2
    docs = make_docs(texts + edge_texts + [mixed], langs=langs + [None] * (len(edge_texts) + 1))
    model = langid.fit(docs, rounds=15)
    rows = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert len(rows) == len(texts) + len(edge_texts) + 1
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [i for i in range(len(texts)) if rows[i]["held_out"]]
    assert np.mean([rows[i]["lang_pred"] == langs[i] for i in held]) > 0.97
    for i, t in enumerate(edge_texts):
        none = t is None or not any(c.isalpha() for c in t)
        assert (rows[len(texts) + i]["lang_pred"] == "und") == none
    assert rows[len(rows) - 1]["n_switches"] >= 1
    assert langid.predict(make_docs([]), model).count() == 0
    bare = make_docs(edge_texts)
    assert {r["lang_pred"] for r in langid.predict(bare, langid.fit(bare)).collect()} == {"und"}
    kept = langid.predict_rows(docs, model).select("row.*")
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_forward_backward_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    em, trans = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    weight = {p: np.exp(sum(em[0, i, p[i]] for i in range(4)) + sum(trans[p[i], p[i + 1]] for i in range(3)))
              for p in product(range(3), repeat=4)}
    z = sum(weight.values())
    want = np.array([[sum(v for p, v in weight.items() if p[i] == k) / z for k in range(3)] for i in range(4)])
    assert np.allclose(langid._forward_backward(em, np.array([4]), trans)[0][0], want)
    t, one, flat = np.exp(trans), np.array([True]), np.full((1, 3), 1 / 3)
    assert np.allclose(langid._posteriors(em, np.array([4]), t, one, flat, flat)[0], want)
    padded = np.concatenate([em, np.zeros((1, 3, 3))], axis=1)
    assert np.allclose(langid._posteriors(padded, np.array([4]), t, one, flat, flat)[0, :4], want)
    # The same chain in blocks of 1, 2 and 1 words, handed over by transfer matrices.
    grid = np.zeros((3, 2, 3))
    grid[0, 0], grid[1], grid[2, 0] = em[0, 0], em[0, 1:3], em[0, 3]
    length, opening = np.array([1, 2, 1]), np.array([True, False, False])
    before, after = langid._carry(langid._transfer(grid, length, t, opening), np.array([0]), np.array([3]))
    got = langid._posteriors(grid, length, t, opening, before, after)
    assert np.allclose(np.concatenate([got[0, :1], got[1], got[2, :1]]), want)


def test_labels_equal_the_whole_chain(make_docs):
    """Texts of up to 20,000 words, of many lengths in one slice, against one uncut forward-backward pass."""
    import pyarrow as pa

    from threadlens.llm import words as W
    rng = random.Random(21)
    texts, langs = _tongues(rng, 120)
    model = langid.fit_rows(list(zip(langs, texts)), rounds=8)
    long = [" ".join(rng.choice(texts) for _ in range(n)) for n in (1, 3, 6, 7, 13, 40, 1000)] + ["", "a", texts[0]]
    w = W.split_words(pa.array(long))
    assert w.counts.max() > 20_000
    got = langid.label_words(w, model)
    h = w.hashes(lower=True)
    feats, first = langid._features(w, np.arange(len(h)), h, model.bits)
    em = langid._emissions(model.weights, feats, first, langid._known(h, model.lexicon, model.member), model.bits)
    for a, b in zip(w.first[:-1], w.first[1:]):
        if b > a:
            want = langid._forward_backward(em[None, a:b], np.array([b - a]), model.transitions)[0][0]
            assert np.allclose(got[a:b], want, atol=1e-9)


def test_language_bounds_and_null_ids(make_docs):
    texts, langs = _tongues(random.Random(5), 60)
    docs = make_docs(texts + ["the thing", "the thing"], ids=[*range(len(texts)), None, None], langs=[*langs, "zz", None])
    with pytest.raises(ValueError, match="max_languages"):
        langid.fit(docs, max_languages=2)
    model = langid.fit(docs, rounds=3)
    assert model.languages == ("aa", "bb", "cc")        # a null id is not learned from
    rows = [r for r in langid.predict(docs, model).collect() if r["doc_id"] is None]
    assert len(rows) == 2 and {r["held_out"] for r in rows} == {False} and {r["lang_pred"] for r in rows} <= {"aa", "bb", "cc"}
