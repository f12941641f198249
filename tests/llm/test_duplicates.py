"""MinHash near-duplicates, substring removal, line joins and decontamination against brute force."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadlens.llm import decontaminate, lines, minhash, substrings
from threadlens.llm.components import components
from threadlens.session import cut_lineage

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t, k):
    w = WORD.findall(low(t))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def edited(rng, text, rate, vocab):
    return " ".join(rng.choice(vocab) if rng.random() < rate else w for w in text.split(" "))


def copies(vocab, n_base=25, seed=2):
    rng = random.Random(seed)
    out = []
    for _ in range(n_base):
        base = " ".join(rng.choice(vocab) for _ in range(rng.randint(2, 150)))
        out += [base] + [edited(rng, base, rng.choice((0.0, 0.01, 0.03, 0.06)), vocab) for _ in range(rng.randint(0, 8))]
    rng.shuffle(out)
    return out


def test_near_duplicates_against_brute_force(make_docs, edge_texts, vocab):
    texts = copies(vocab) + edge_texts
    sets = [shingles(t, 4) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    rows = {r["doc_id"]: r for r in minhash.near_duplicates(make_docs(texts)).collect()}
    for i in range(len(texts)):
        assert rows[i]["n_shingles"] == len(sets[i])
        assert rows[i]["component_id"] == find(i) and rows[i]["kept"] == (find(i) == i)


def test_near_duplicates_ids(make_docs):
    docs = make_docs(["a b c d e f", "a b c d e f", "a b c d e f", "z y"], ids=[3, 3, None, 1])
    rows = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect())
    assert rows == [(-1, None, True), (1, 1, True), (3, 3, True), (3, 3, True)]
    assert minhash.near_duplicates(make_docs([])).count() == 0
    kept = minhash.distinct_rows(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.select("doc_id").collect()) == [-1, 1, 3]


def test_repeated_ids_keep_different_texts(make_docs):
    a, b, c = "a b c d e f g", "q r s t u v w", "k l m n o p q"
    docs = make_docs([a, b, b, c, a, None, c], ids=[3, 3, 3, 3, 5, 4, None])
    kept = minhash.distinct_rows(docs)
    assert kept.columns == docs.columns
    named = minhash.distinct_rows(docs.withColumn("_row_key", F.lit("mine")))
    assert {r["_row_key"] for r in named.collect()} == {"mine"} and named.count() == kept.count()
    got = sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.select("doc_id", "text").collect())
    assert got == [(-1, c), (3, a), (3, c), (3, b), (4, "")]


def test_posterior_pruning_bounds():
    # A pair at the threshold passes all batches but with the chosen probability.
    plan = minhash.least_matches(512, 0.8, 1e-5)
    assert [n for n, _ in plan] == [256, 512]
    for n, m in plan:
        assert minhash.posterior(m, n, 0.8) >= 1e-5 > (minhash.posterior(m - 1, n, 0.8) if m else 0)


def test_equal_bytes_by_bit_planes(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    low = rng.integers(0, 2 ** 63, size=(40, 512), dtype=np.uint64)
    low[20:] = np.where(rng.random((20, 512)) < 0.7, low[:20], low[20:])
    byte = (low >> np.uint64(56)).astype(np.uint8) ^ (low >> np.uint64(7)).astype(np.uint8)
    planes = minhash.bit_planes(low)
    rows = [(planes[i].tolist(), planes[20 + i].tolist(), int((byte[i] == byte[20 + i]).sum())) for i in range(20)]
    df = spark.createDataFrame(rows, "x array<long>, y array<long>, want int")
    total = sum((minhash._equal_bytes([F.col("x")[8 * g + j] for j in range(8)], [F.col("y")[8 * g + j] for j in range(8)])
                 for g in range(8)), F.lit(0))
    assert df.where(total != F.col("want")).count() == 0


def test_components_of_paths_and_stars(spark):
    pairs = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 60)] + [(7000, 6999)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {got[i] for i in range(301)} == {0} and {got[1000 + i] for i in range(60)} == {1000}
    assert got[7000] == got[6999] == 6999 and len(got) == 301 + 60 + 2
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed_by_force(texts, ids, width):
    words = [WORD.findall(t or "") for t in texts]
    least = {}
    for i, w in zip(ids, words):
        for p in range(len(w) - width + 1):
            key = tuple(w[p:p + width])
            least[key] = min(least.get(key, i), i)
    out = {}
    for i, w in zip(ids, words):
        gone = set()
        for p in range(len(w) - width + 1):
            if least[tuple(w[p:p + width])] < i:
                gone.update(range(p, p + width))
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def passages(vocab, seed=8):
    rng = random.Random(seed)
    shared = [" ".join(rng.choice(vocab) for _ in range(rng.randint(50, 130))) for _ in range(6)]
    texts = []
    for i in range(120):
        parts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 3)):
            parts += [edited(rng, rng.choice(shared), rng.choice((0, 0, 0.01)), vocab),
                      " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40)))]
        texts.append("\n".join(parts))
    return texts + ["x " * 200, "x " * 130, "x y " * 60]


def test_substrings_against_brute_force(make_docs, edge_texts, vocab, monkeypatch):
    texts = passages(vocab) + edge_texts
    want = removed_by_force(texts, range(len(texts)), 50)
    rows = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"])
            for r in substrings.remove_repeats(make_docs(texts)).collect()}
    assert rows == want
    # Every anchor as a hot one: the exact way beside the automata gives the same.
    monkeypatch.setattr(substrings, "SHARD_CONTEXTS", 1)
    rows = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"])
            for r in substrings.remove_repeats(make_docs(texts)).collect()}
    assert rows == want
    assert substrings.remove_repeats(make_docs([])).count() == 0


def test_substrings_null_ids(make_docs, vocab):
    text = " ".join(vocab[:80])
    rows = substrings.remove_repeats(make_docs([text, text, text], ids=[None, 2, 1])).collect()
    assert {r["doc_id"]: r["n_removed"] for r in rows} == {None: 0, 1: 0, 2: 80}


def test_substrings_of_repeated_ids(make_docs, vocab):
    """Rows that share an id and not a text: each loses what a smaller id holds, and nothing else."""
    p, q, r = (" ".join(vocab[i:i + 60]) for i in (0, 100, 200))
    docs = make_docs([p, p, q, r + " " + p, r, None, q], ids=[1, 2, 2, 3, 3, 2, 5])
    rows = sorted((x["doc_id"], x["n_words"], x["n_removed"], x["kept"]) for x in substrings.remove_repeats(docs).collect())
    assert rows == sorted([(1, 60, 0, p), (2, 60, 60, ""), (2, 60, 0, q), (3, 120, 60, r), (3, 60, 0, r), (2, 0, 0, ""),
                           (5, 60, 60, "")])


def test_given_reference(make_docs, spark, vocab):
    rng = random.Random(3)
    ref = " ".join(rng.choice(vocab) for _ in range(300))
    inside = " ".join(ref.split(" ")[100:170])
    docs = make_docs(["before " + inside + " after", " ".join(ref.split(" ")[:49]), None])
    refs = spark.createDataFrame([(ref,), (None,)], "text string")
    for size in (200_000, 60):
        rows = {r["doc_id"]: r for r in substrings.remove_reference(docs, refs, shard_words=size).collect()}
        assert rows[0]["kept"] == "before after" and rows[0]["n_removed"] == 70
        assert rows[1]["n_removed"] == 0 and rows[2]["n_words"] == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=14), min_size=1, max_size=5), st.integers(1, 5))
def test_suffix_automaton(seqs, width):
    auto = substrings.SuffixAutomaton()
    for i, s in enumerate(seqs):
        auto.add(s, i)
    for s in seqs:
        want = [min(i for i, t in enumerate(seqs) if any(t[q:q + width] == s[p:p + width] for q in range(len(t))))
                for p in range(len(s) - width + 1)]
        assert auto.owners(s, width) == want


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        q = [i]
        for j, d in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (c != d)))
        p = q
    return p[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=14), st.text("abc", max_size=14), st.integers(1, 4))
def test_banded_distance(a, b, tau):
    assert lines.edit_distance_within(a, b, tau) == (distance(a, b) <= tau)


def linked(lines, tau, step):
    """An edit for every ``step`` characters of the shorter line, at most ``tau``."""
    def allowed(x, y):
        return min(tau, min(len(x), len(y)) // step)

    return {x: {y for y in lines if x != y and abs(len(x) - len(y)) <= allowed(x, y) and distance(x, y) <= allowed(x, y)}
            for x in lines}


def test_lines_against_brute_force(make_docs, edge_texts):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdé 語") for _ in range(rng.randint(25, 60))).strip() for _ in range(25)]

    def vary(s):
        s = list(s)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(s))
            s[i:i + rng.randint(0, 1)] = rng.choice(["", "x", "é"])
        return "".join(s)

    texts = ["\n".join(rng.choice(["", " ", "\t"]) + vary(rng.choice(base)) for _ in range(rng.randint(1, 8)))
             for _ in range(60)] + edge_texts
    trimmed = [[(i, x.strip(" \t\n\x0b\f\r")) for i, x in enumerate((t or "").split("\n"))] for t in texts]
    trimmed = [[(i, x) for i, x in ls if x] for ls in trimmed]
    first = {}
    for d, ls in enumerate(trimmed):
        for i, x in ls:
            first.setdefault(x, (d, i))
    near = linked([x for x in first if len(x) < 1000], 2, 10)
    assert sum(map(len, near.values())) > 20
    rows = {r["doc_id"]: r for r in lines.line_duplicates(make_docs(texts)).collect()}
    for d, ls in enumerate(trimmed):
        want = (len(ls), sum((d, i) != first[x] for i, x in ls),
                sum((d, i) == first[x] and any(first[y] < first[x] for y in near.get(x, ())) for i, x in ls),
                sum(len(near.get(x, ())) for x in {x for _, x in ls}))
        r = rows[d]
        assert (r["n_lines"], r["n_exact"], r["n_near"], r["n_links"]) == want
    assert lines.line_duplicates(make_docs([])).count() == 0


def test_line_query_links_short_lines(spark, tmp_path, make_docs):
    """The registered query against brute force over lines of every length, short boilerplate among them."""
    from threadlens.llm.queries import op8_line_dedup

    rng = random.Random(8)
    base = ["All rights reserved.", "abc", "xyz w", "Read more", "12", "q", "Read the terms"]
    base += ["".join(rng.choice("abcdé 語") for _ in range(rng.randint(1, 29))).strip() or "z" for _ in range(30)]

    def vary(s):
        i = rng.randrange(len(s))
        return (s[:i] + rng.choice(["", "x", "é"]) + s[i + rng.randint(0, 1):]).strip() or "z"

    texts = ["\n".join(vary(rng.choice(base)) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts += ["All rights reserved.", "All rights reserved"]
    make_docs(texts).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    every = [[x.strip(" \t\n\x0b\f\r") for x in t.split("\n")] for t in texts]
    first = {}
    for d, ls in enumerate(every):
        for i, x in enumerate(ls):
            first.setdefault(x, (d, i))
    near = linked(list(first), 2, 10)
    assert any(len(x) < 20 and near[x] for x in near) and not any(near[x] for x in near if len(x) < 10)
    rows = {r["doc_id"]: r for r in op8_line_dedup(spark, str(tmp_path)).collect()}
    for d, ls in enumerate(every):
        want = (sum((d, i) == first[x] and any(first[y] < first[x] for y in near.get(x, ())) for i, x in enumerate(ls)),
                sum(len(near.get(x, ())) for x in set(ls)))
        assert (rows[d]["n_near"], rows[d]["n_links"]) == want, ls


def test_near_copies_of_one_line_are_rows_of_lines(make_docs, monkeypatch):
    """Every pair of a large group is linked, but no table has a row a pair, in one block or in many."""
    copies = [f"{'a line that very many texts hold with':<40}{chr(97 + i // 12)}{chr(109 + i % 12)} at its end" for i in range(144)]
    written = []

    def cut(df, *more, **named):
        out = cut_lineage(df, *more, **named)
        written.append(out.count())
        return out

    monkeypatch.setattr(lines, "cut_lineage", cut)
    for block in (lines.BLOCK_LINES, 50):
        monkeypatch.setattr(lines, "BLOCK_LINES", block)
        rows = {r["doc_id"]: r for r in lines.line_duplicates(make_docs(copies)).collect()}
        assert all(r["n_links"] == 143 and r["n_near"] == (d > 0) for d, r in rows.items())
    assert max(written) < 144 * 143 / 4


def test_lines_of_texts_that_share_an_id(make_docs):
    """A line is compared as it stands, whichever text of its id holds it."""
    texts = ["first line of this text\none line that is alike", "another text, another line\nquite other words here",
             "one line that is alik"]
    rows = lines.line_duplicates(make_docs(texts, ids=[1, 1, 2])).collect()
    assert sorted((r["doc_id"], r["n_lines"], r["n_exact"], r["n_near"], r["n_links"]) for r in rows) == [
        (1, 4, 0, 0, 1), (1, 4, 0, 0, 1), (2, 1, 0, 1, 1)]


def test_decontamination_against_brute_force(make_docs, edge_texts, spark, vocab):
    rng = random.Random(12)
    items = [" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 70))) for _ in range(40)] + [None, "", "one two"]
    items.append(items[0])
    texts = list(edge_texts)
    for i in range(150):
        host = " ".join(rng.choice(vocab) for _ in range(rng.choice((0, 20, 400, 4000)))).split(" ")
        at = rng.randrange(len(host) + 1)
        part = edited(rng, rng.choice(items[:40]), rng.choice((0, 0, 0.02, 0.05)), vocab).split(" ")
        texts.append(" ".join(host[:at] + part[:rng.choice((len(part), len(part), len(part) // 2))] + host[at:]).upper())
    items += ["two", "zzz yyy", texts[-1].split(" ")[0], "same same same same same same same", "three word run", "Same"]
    texts += ["one two three", "a THREE word run", "three words run", "same " * 20, "zzz", "zzz yyy"]

    def runs(t, q):
        w = WORD.findall(low(t))
        return {tuple(w[i:i + q]) for i in range(len(w) - q + 1)}

    want = set()
    for i, x in enumerate(items):
        q = min(5, len(WORD.findall(x or "")))
        s = runs(x, q) if q else set()
        for d, t in enumerate(texts):
            shared = len(s & runs(t, q)) if s else 0
            if s and 100 * shared >= 80 * len(s):
                want.add((d, i, shared, len(s)))
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = make_docs(texts)
    got = {(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in decontaminate.matches(docs, table).collect()}
    assert got == want and len(want) > 50
    clean = decontaminate.clean_rows(docs, table)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.select("doc_id").collect()} == set(range(len(texts))) - {d for d, *_ in want}
    assert decontaminate.matches(docs, table.limit(0)).count() == 0 and decontaminate.matches(make_docs([]), table).count() == 0
    assert decontaminate.clean_rows(docs, table.limit(0)).count() == len(texts)


def test_decontamination_bitmap_lets_all_keys_through(spark):
    """No key of the set is lost; a full bitmap costs only chance candidates, which the exact count drops."""
    import numpy as np

    keys = spark.range(5000).select(F.xxhash64("id").alias("mark"))
    held = np.array([r["mark"] for r in keys.collect()], dtype=np.int64).view(np.uint64)
    other = decontaminate.W.mix64(np.arange(200_000, dtype=np.uint64))
    for n in (5000, 1):
        bitmap = decontaminate.bitmap_of(keys, "mark", n)
        assert len(bitmap.has(held)) == 5000 and len(bitmap.has(other)) < 200


def test_decontamination_memory_of_single_shingle_items(spark):
    """An item of one shingle in the benchmark keeps a worker's arrays at a few times its slice."""
    import tracemalloc

    import pyarrow as pa
    table = spark.createDataFrame([(1, "one two three four five"), (2, "six"), (3, " ".join(f"w{i}" for i in range(40)))],
                                  "item_id long, text string")
    rows = decontaminate.item_rows(table, 5, True, 64, "item_id", "text").collect()
    classes = sorted({(r["q"], r["width"]) for r in rows})
    assert classes == [(1, 1), (5, 1), (5, 64)]
    marks = spark.createDataFrame([(x,) for r in rows for x in r["keys"]], "mark long")
    empty = decontaminate.bitmap_of(marks, "mark", 1000)
    look = decontaminate.Windows(classes, empty, empty, 5, True, 64)
    text = pa.array(["ab cd e " * (decontaminate.SLICE_BYTES // 8)])
    list(look.search(text))
    tracemalloc.start()
    list(look.search(text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 * decontaminate.SLICE_BYTES
