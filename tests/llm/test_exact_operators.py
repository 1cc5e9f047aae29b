"""The operators whose results a plain computation gives, on small tables with nulls, ties, repeats and odd texts."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import as_tuples, docs_frame, lower_az, words_of
from pyspark.sql import functions as F

from faultline.llm import bitmaps, components, decontaminate, jaccard_join, mixing, substring_dedup, tokens, url_filter, warc

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(n, vocabulary, seed):
    draw = random.Random(seed)
    return [draw.choice(vocabulary) for _ in range(n)]


VOCABULARY = [f"w{i}" for i in range(400)] + ["Été", "ñandú", "WORD", "x"]


# --- helpers ---------------------------------------------------------------------


def test_words_and_hashes_of_a_column():
    texts = ["a b\tc", None, "", " lead", "trail ", "é\u00a0è x", "B b", "q" * 70_000, "last"]
    found = tokens.hashed_words(pa.array(texts), lower=True)
    own = [[found.data[a:b].tobytes().decode() for a, b in zip(found.starts[i:j], found.ends[i:j])] for i, j in zip(found.first[:-1], found.first[1:])]
    assert own == [words_of(lower_az(t)) for t in texts]
    by_word = {}
    for word, h in zip([w for ws in own for w in ws], found.hashes):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_bitmap_passes_every_key(spark):
    keys = spark.range(1000).select(F.xxhash64("id").alias("k"))
    values = np.array([r.k for r in keys.collect()], np.int64)
    bitmap = bitmaps.bitmap_of(keys, "k")
    assert bitmaps.may_hold(bitmap, values).all()
    others = np.arange(1, 100_000, dtype=np.int64)
    assert bitmaps.may_hold(bitmap, others).mean() < 0.1
    assert not bitmaps.may_hold(bitmaps.bitmap_of(keys.limit(0), "k"), values).any()


def test_components(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(0, 0)]
    root = {}
    def top(x):
        while root.get(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    expected = sorted((x, top(x)) for x in {v for e in edges for v in e} if top(x) != x)
    assert as_tuples(components.components(spark.createDataFrame(edges, "a long, b long")), "node", "root") == sorted(expected, key=str)


# --- url filter ------------------------------------------------------------------

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/", "allow")]


def test_url_filter(spark):
    urls = ["http://A.Example.NET/en/1?x", "http://example.net/de/", "https://www.bad.com/p?utm_source=a&z=1#top", "http://bad.com/p?z=1", "bad.com/p", None, "",
            "http://bad.com:80/p?z=1", "http://bad.com", "x://notorg/fr/a", "x://a.org/fr/", "x://org/fr", "http://h?q=/a", "http://h#://x/en/"]
    pages = spark.createDataFrame([(i, u, "x", True, 1, 2) for i, u in enumerate(urls + urls[:2])], "page_id long, url string, host string, possible boolean, w0 long, block int")
    listed = spark.createDataFrame([("http://bad.com/p?z=1",), (None,), ("nothing",)], "url string")
    for blocks in (1, 1 << 15):  # with one block nearly every probe passes, the exact join decides
        rows = {r.page_id: r for r in url_filter.judge(pages, listed, RULES, blocks).collect()}
        assert len(rows) == len(urls) + 2
        for i, u in enumerate(urls + urls[:2]):
            host, path = "", ""
            if u and "://" in u:
                m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1])
                host, path = lower_az(m[1]), m[2]
            rule = max((r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])), key=lambda r: len(r[0] + r[1]), default=None)
            assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule and rule[0] + rule[1])
            assert rows[i].listed == (i in (2, 3, 7))
            assert rows[i].verdict == (rule[2] if rule else "block" if rows[i].listed else "allow")
    assert url_filter.judge(pages.limit(0), listed, RULES).count() == 0
    assert url_filter.judge(pages, listed.limit(0), RULES).where("listed").count() == 0


# --- decontamination -------------------------------------------------------------


def judged_plainly(docs, items):
    windows = {}
    for i, w in [(i, re.findall(ALNUM, lower_az(t))) for i, t in items]:
        size = min(10, len(w))
        for s in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[s:s + size]), set()).add(str(i))
    out = []
    for d, t in docs:
        w = re.findall(ALNUM, lower_az(t))
        hit, held = set(), set()
        for size in {len(k) for k in windows}:
            for s in range(len(w) - size + 1):
                if tuple(w[s:s + size]) in windows:
                    hit.update(range(s, s + size))
                    held |= windows[tuple(w[s:s + size])]
        out.append((d, len(w), len(hit), sorted(held), bool(hit)))
    return sorted(out, key=str)


def test_decontamination(spark):
    passage = words(30, VOCABULARY, 1)
    items = [(1, " ".join(passage)), (2, "one two three"), (3, None), (4, ""), (5, "!?"), (6, " ".join(passage[5:25])), (1, " ".join(words(12, VOCABULARY, 2))), (7, "Solo")]
    filler = " ".join(words(60, VOCABULARY, 3))
    docs = [(1, filler), (2, filler + " " + " ".join(passage[3:17]) + " " + filler), (3, None), (4, ""), (5, "zero ONE, two--three four"), (6, " ".join(passage[:9])),
            (7, ". ".join(passage).upper()), (8, "solo! solo"), (9, " ".join(passage * 40)), (2, filler + " " + " ".join(passage[3:17]) + " " + filler), (None, "one two three")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit("clash"))
    out = decontaminate.judge(docs_frame(spark, docs), bench)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in out.collect()), key=str)
    assert got == judged_plainly(docs, items)
    assert "key" in out.columns and decontaminate.judge(docs_frame(spark, docs), bench, keep_text=False).columns.count("text") == 0
    assert decontaminate.judge(docs_frame(spark, docs), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.judge(docs_frame(spark, docs).limit(0), bench).count() == 0


# --- WARC ------------------------------------------------------------------------


def test_archive_round_trip(spark):
    big, other = "x" * 150, "é" * 60
    rows = [(5, "http://b.org/1", big), (3, "http://a.org/2?q=1", big), (3, "http://a.org/2?q=1", big), (9, None, big), (1, "u", None), (2, "u", ""), (4, "http://a.org", "tiny"),
            (6, "http://a.org", "tiny"), (7, "http://z.com/é\r\nx", other), (8, "http://z.com/", other), (None, "http://n.com", other), (10, "http://q", "y" * 200_000)]
    rows += [(100 + i, "http://same.org/", f"page {i} " * 30) for i in range(700)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash")).repartition(5)
    got = warc.archive_round_trip(pages).collect()
    firsts = {}
    for p, _, h in rows:
        if h and len(h.encode()) >= 100 and p is not None:
            firsts[h] = min(firsts.get(h, p), p)
    expected = []
    for p, u, h in rows:
        payload = (h or "").encode()
        first = firsts.get(h) if len(payload) >= 100 else None
        revisit = first is not None and p != first
        expected.append((p, u, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", first if revisit else None, None if revisit else payload))
    found = [(r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


# --- substring dedup -------------------------------------------------------------


def removed_plainly(rows, size=20):
    seen, out = {}, []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][2]))
    gone = {i: set() for i in order}
    for i in order:
        w = words_of(rows[i][1])
        for s in range(len(w) - size + 1):
            k = tuple(w[s:s + size])
            first = seen.setdefault(k, (rows[i][0], rows[i][2], s))
            if first != (rows[i][0], rows[i][2], s):
                gone[i].update(range(s, s + size))
    for i, (d, t, _) in enumerate(rows):
        w = words_of(t)
        out.append((d, len(w), len(gone[i]), " ".join(x for p, x in enumerate(w) if p not in gone[i])))
    return sorted(out, key=str)


def test_substring_dedup(spark):
    a, b, c = (words(90, VOCABULARY, s) for s in (1, 2, 3))
    texts = [(4, " ".join(a)), (2, "  ".join(b + a[10:60])), (7, "\n".join(a[20:45] + c)), (1, None), (3, ""), (5, "short text"), (6, "r " * 300), (8, "r\t" * 41),
             (9, " ".join(c[:50] + c[:50])), (4, " ".join(a)), (10, " ".join(a[:19])), (None, " ".join(b[30:80])), (11, " ".join(words(5000, VOCABULARY[:3], 9))), (2, " ".join(c))]
    frame = docs_frame(spark, texts)
    keyed = {(r.doc_id, r.text): r.k for r in frame.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k")).collect()}
    out = substring_dedup.remove_repeats(frame)
    assert as_tuples(out, "doc_id", "n_words", "n_removed", "kept_text") == removed_plainly([(d, t, keyed[d, t]) for d, t in texts])
    assert set(frame.columns) <= set(out.columns)
    assert substring_dedup.remove_repeats(frame.limit(0)).count() == 0


def test_equal_hashes_of_different_windows_are_told_apart():
    kinds = [0, 1, 0, 1, 1, 2]
    found = substring_dedup.repeats(np.zeros(6, np.uint64), np.arange(6), np.zeros(6, np.int64), np.zeros(6, np.int64),
                                    lambda i, j: np.array([kinds[x] == kinds[y] for x, y in zip(i, j)], bool))
    assert found.tolist() == [False, False, True, True, True, False]


# --- Jaccard join ----------------------------------------------------------------


def shingles(text):
    w = words_of(lower_az(text))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_plainly(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (d, _), g in zip(rows, group):
        least[g] = min((x for x in (least.get(g), d) if x is not None), default=None)
    return sorted(((d, len(s), least[g]) for (d, _), s, g in zip(rows, sets, group)), key=str)


def edited_copies(base, n, edits, seed):
    draw = random.Random(seed)
    for _ in range(n):
        w = list(base)
        for _ in range(draw.randrange(edits + 1)):
            w[draw.randrange(len(w))] = f"new{draw.randrange(10 ** 6)}"
        yield " ".join(w)


def test_jaccard_join(spark):
    rows, d = [], 0
    for size in (1, 3, 5, 6, 8, 9, 12, 20, 40, 90, 200, 600):
        base = words(size, VOCABULARY, size)
        for text in edited_copies(base, 14, max(1, size // 40), size):
            rows.append((97 - d if d % 3 else d + 1000, text))
            d += 1
        rows.append((2000 + size, " ".join(base[:-1])))
        rows.append((3000 + size, " ".join(base).upper()))
    common = words(60, VOCABULARY, 77)  # a passage that many otherwise different texts share
    rows += [(5000 + i, " ".join(common + words(15 + i, VOCABULARY, 500 + i))) for i in range(60)]
    rows += [(6000, None), (6001, ""), (6002, " \n"), (None, rows[5][1]), (rows[7][0], rows[7][1]), (6003, "x " * 3000), (6004, "X " * 2000)]
    out = jaccard_join.near_duplicates(docs_frame(spark, rows))
    assert as_tuples(out, "doc_id", "n_shingles", "component_id") == near_plainly(rows)
    assert jaccard_join.near_duplicates(docs_frame(spark, rows).limit(0)).count() == 0


def test_open_groups_in_blocks(spark):
    draw = np.random.default_rng(5)
    base = draw.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = {}
    for i in range(40):  # five families of near sets, all of which share one signature
        own = np.concatenate([base[:20], draw.integers(0, 1 << 63, 40, dtype=np.uint64)]) if i % 8 == 0 else sets[i - i % 8].copy()
        own[40 + i % 8] = i
        sets[i] = np.unique(own)
    rows = [(7, i, 0, i, 0) for i in range(1, 40)]
    marked = spark.createDataFrame(rows, "sig long, node long, head long, comp long, head_comp long")
    sketches = spark.createDataFrame([(i, len(s), bytearray(jaccard_join.parity_sketch(s))) for i, s in sets.items()], "key long, n long, sketch binary")
    found = [{(r.a, r.b) for r in jaccard_join.open_pairs(marked, sketches, 3, block).collect()} for block in (1000, 9, 2)]
    assert found[0] == found[1] == found[2]
    links = {(a, b) for a in sets for b in sets if 0 < a < b and jaccard_join.linked(sets[a], sets[b])}
    assert links and links <= found[0] and not any(0 in p for p in found[0])


@pytest.mark.parametrize("frequent_share", [0.0, 0.5, 1.0])
def test_linked_sets_share_a_signature(frequent_share):
    draw = np.random.default_rng(11)
    for n in [4, 5, 6, 7, 9, 10, 14, 23, 50, 128, 400, 1500]:
        for _ in range(25):
            a = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64))
            most = len(a) // 9  # a symmetric difference of 2n/9 links sets of one size
            drop = draw.integers(0, most + 1)
            b = np.concatenate([a[drop:], draw.integers(0, 1 << 63, draw.integers(0, most + 1), dtype=np.uint64)])
            b = np.unique(b)
            if not jaccard_join.linked(a, b):
                continue
            frequent = np.sort(draw.choice(a, int(len(a) * frequent_share), replace=False))
            sig, owner = jaccard_join.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), frequent)
            assert set(sig[owner == 0]) & set(sig[owner == 1]), (n, len(a), len(b))


def test_subsets_of_parts_are_signed():
    """A set that lost one element keeps all signatures but the two of the subsets that held its part."""
    draw = np.random.default_rng(3)
    a = np.unique(draw.integers(0, 1 << 63, 60, dtype=np.uint64))
    while len(jaccard_join.signatures(a, np.array([0, len(a)]), np.empty(0, np.uint64))[0]) % jaccard_join.PARTS:
        a = np.unique(draw.integers(0, 1 << 63, 60, dtype=np.uint64))  # one without weak subsets, signed under one cut of each band
    b = a[1:]
    both = [set(jaccard_join.signatures(x, np.array([0, len(x)]), np.empty(0, np.uint64))[0].tolist()) for x in (a, b)]
    bands = 2
    assert len(both[0] - both[1]) == bands * (jaccard_join.PARTS - 1)


# --- mixing ----------------------------------------------------------------------


def targets_plainly(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in names if s not in capped)
        level = (share * total - sum(cap * sizes[s] for s in capped)) / free if free else 0
        more = {s for s in names if s not in capped and level * weight[s] > cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= more


def test_mixing(spark):
    draw = random.Random(3)
    rows = [(i, " ".join(words(draw.randrange(1, 60), VOCABULARY, i)), draw.choice(["a", "b", "é", "big", "big", "big", None, "z", "tiny"] if i % 50 else ["tiny2"])) for i in range(1500)]
    rows += [(9000, None, "a"), (9001, "", "empty"), (9002, None, None), (None, "x y", "b"), (3, rows[3][1], rows[3][2])]
    frame = docs_frame(spark, rows)
    out = mixing.with_copies(frame).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words_of(t))
    expected, taken = targets_plainly(sizes), {}
    assert len(out) == len(rows)
    for r in out:
        assert r.size == len(words_of(r.text)) and r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source])
        assert 0 <= r.copies <= 2 and (not r.size or r.copies - r.target / r.source_size < 1)
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    assert sum(expected.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert taken["big"] == pytest.approx(expected["big"], rel=0.1)
    copies = as_tuples(mixing.mix(frame), "doc_id", "source", "copy")
    assert copies == as_tuples(mixing.mix(frame.repartition(7)), "doc_id", "source", "copy")
    assert len(copies) == sum(r.copies for r in out)
    assert mixing.mix(frame.limit(0)).count() == 0 and mixing.with_copies(frame.where("n_words > 0")).count() == 0
    assert mixing.with_copies(frame.where("doc_id = 9001")).first().copies == 0
