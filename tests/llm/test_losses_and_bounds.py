"""Cases in which rows or likeness were lost, and bounds of what reaches the driver."""

import numpy as np
from helpers import docs_frame
from pyspark.sql import functions as F

import corpus_pipeline
from faultline.llm import fingerprints, labelled, lattice_lm, mixing, quality, storage, substring_dedup

NEAR = "one two three four five six seven eight nine ten " * 12


def staged(spark, rows):
    return sorted(((r.doc_id, r.text) for r in corpus_pipeline.one_of_near_copies(spark, docs_frame(spark, rows), "").collect()), key=str)


def test_near_copies_go_by_row_not_by_id(spark):
    other = " ".join(f"w{i}" for i in range(60))
    copy = NEAR + "eleven"
    assert staged(spark, [(1, NEAR), (2, NEAR), (2, other), (None, copy), (None, NEAR)]) == [(1, NEAR), (2, other)]
    # without ids one row stays; equal rows leave one; rows without words all stay
    assert len(staged(spark, [(None, NEAR), (None, copy), (None, NEAR)])) == 1
    assert staged(spark, [(5, other), (5, other), (6, None), (6, None), (7, ""), (None, " ")]) == sorted([(5, other), (6, None), (6, None), (7, ""), (None, " ")], key=str)
    # of two near texts with one id, one
    assert len(staged(spark, [(3, NEAR), (3, copy)])) == 1


def test_long_texts_without_spaces_are_likened(spark):
    draw = np.random.default_rng(4)
    rows = [(i, "".join(map(chr, draw.integers(0x4E00, 0x9FA5, n)))) for i, n in enumerate([590, 600, 601, 640, 3000, 30_000])]
    out = {r.doc_id: r for r in fingerprints.compared(docs_frame(spark, rows)).collect()}
    for i, r in out.items():
        assert 0.35 < r.near_edited < 0.75 and r.near_next < 0.1, (i, r.near_edited)


def test_a_long_word_counts_as_its_characters(spark):
    text = F.lit("a " + "x" * 25 + " b")
    assert spark.range(1).select(fingerprints.units(text).alias("u")).first().u == ["a", *"x" * 25, "b"]


def test_sample_has_one_text_for_each_id(spark):
    docs = docs_frame(spark, [(1, f"text {i}") for i in range(50)] + [(2, None), (2, None), (3, "c")])
    sample = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, label int")
    got = labelled.sampled_texts(docs, sample).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3] and {r.text for r in got if r.doc_id == 2} == {""}


def test_quality_fit_is_bounded_in_bytes(spark):
    rows = [(i, ("good words here " if i % 2 else "bad junk 000 ") * (1 + i % 5)) for i in range(1, 200)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    docs = docs_frame(spark, rows)
    assert isinstance(quality.train(docs, labels, max_bytes=20_000), quality.Model)
    assert quality.train(docs, labels, max_bytes=1).scores  # one row alone still gives a model


def test_rows_without_ids_draw_apart(spark):
    out = mixing.with_copies(docs_frame(spark, [(None, f"w{i} " * 10, "s") for i in range(300)]))  # each document 1.5 times
    assert 100 < out.where("copies = 1").count() < 200 and out.where("copies not in (1, 2)").count() == 0


def test_buckets_grow_with_the_texts(spark):
    docs = docs_frame(spark, [(i, "abcdefgh " * 1000) for i in range(50)])
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert storage.buckets_for(docs, "text", 1 << 30) == least
    assert storage.buckets_for(docs, "text", 10_000) == 45
    assert storage.buckets_for(docs.limit(0), "text", 10_000) == least


def test_repeats_in_one_hot_passage(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"head{i} {passage} " + " ".join(f"t{i}x{j}" for j in range(30))) for i in range(200)]
    out = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs_frame(spark, rows, 6)).collect()}
    assert out[0] == (71, 0) and all(out[i] == (71, 40) for i in range(1, 200))


def test_lattice_finds_every_piece():
    pieces = [b"a", b"b", b"ab", bytes([200]), b"abc", b"ba"]
    lattice = lattice_lm.Lattice(pieces, np.zeros((1, len(pieces))))
    rows, found = lattice.pieces_of(lattice.hashes.copy())
    assert sorted(zip(rows.tolist(), found.tolist())) == [(i, i) for i in range(len(pieces))]


def test_records_are_valid_warc(spark, tmp_path):
    import glob
    import gzip
    import re
    from datetime import datetime, timezone

    from faultline.llm import warc

    html = "<html>" + "é" * 100 + "</html>"
    rows = [(1, "http://a.example/x?y=1", html), (2, "http://b.example/ü z", html), (3, None, None), (None, "http://c.example/", "n" * 200), (4, "http://c.example/", html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    captures, shards = warc.write_archive(pages, f"file://{tmp_path}", date=datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc))
    assert captures.count() == len(rows)
    found = {}
    for name in glob.glob(f"{tmp_path}/archive/*.warc.gz"):
        with gzip.open(name) as f:  # members one after the other
            raw = f.read()
        while raw:
            head, _, rest = raw.partition(b"\r\n\r\n")
            lines = head.split(b"\r\n")
            assert lines[0] == b"WARC/1.1"
            fields = dict(x.split(b": ", 1) for x in lines[1:])
            block, raw = rest[:int(fields[b"Content-Length"])], rest[int(fields[b"Content-Length"]) + 4:]
            assert rest[len(block):len(block) + 4] == b"\r\n\r\n"
            assert fields[b"WARC-Date"] == b"2024-01-02T03:04:05Z" and re.fullmatch(rb"<urn:uuid:[0-9a-f-]{36}>", fields[b"WARC-Record-ID"])
            assert re.fullmatch(rb"[a-z]+:[!-~]+", fields[b"WARC-Target-URI"]) and fields[b"Content-Type"] == b"application/http; msgtype=response"
            http, _, body = block.partition(b"\r\n\r\n")
            assert http.startswith(b"HTTP/1.1 200 OK\r\n")
            found[int(fields.get(b"X-Page-Id", b"-1"))] = (fields, body)
    assert {k: f[b"WARC-Type"] for k, (f, _) in found.items()} == {1: b"response", 2: b"revisit", 3: b"response", -1: b"response", 4: b"revisit"}
    for k in (2, 4):
        fields, body = found[k]
        assert body == b"" and fields[b"WARC-Refers-To"] == found[1][0][b"WARC-Record-ID"] and fields[b"WARC-Refers-To-Target-URI"] == b"http://a.example/x?y=1"
        assert fields[b"WARC-Profile"].endswith(b"/identical-payload-digest")
    assert found[1][1] == html.encode() and found[3][1] == b""
    back = {r.page_id: (r.url, r.payload_bytes, r.refers_to) for r in warc.look_up(captures.select("key").distinct(), shards, f"file://{tmp_path}").collect()}
    n = len(html.encode())
    assert back == {1: (rows[0][1], n, None), 2: (rows[1][1], n, 1), 3: (None, 0, None), None: (rows[3][1], 200, None), 4: (rows[4][1], n, 1)}


def test_filter_follows_the_list(spark):
    from faultline.llm import url_filter
    assert [url_filter.blocks_for(n) for n in (0, 1000, 100_000, 10**6, 10**9)] == [1 << 10, 1 << 10, 1 << 12, 1 << 15, 1 << 19]
    listed = spark.range(200_000).selectExpr("concat('http://h', id, '.example/p') as url")
    others = spark.range(50_000).selectExpr("id as page_id", "concat('http://o', id, '.example/p') as url")
    keys = url_filter.with_parts(listed)
    n = url_filter.blocks_for(200_000)
    passed = url_filter.with_possible(url_filter.with_parts(others), "canonical", url_filter.build_filter(keys, "canonical", n), n).where("possible").count()
    assert passed < 500  # under one in a hundred
    some = others.union(listed.limit(3).selectExpr("-1L as page_id", "url"))
    assert url_filter.judge(some, listed, []).where("listed").count() == 3


def test_language_model_score_equals_a_plain_computation(spark):
    import math
    import random
    import zlib
    from collections import Counter

    import public_tokenizers
    from helpers import lower_az, words_of

    path = public_tokenizers.path("piece_bpe_32k.model")
    draw = random.Random(6)
    rows = [(i, " ".join(draw.choice(["the", "ab", "Ab", "x9", "é"]) for _ in range(draw.randrange(0, 6)))) for i in range(40)] + [(50, "unseen the"), (51, None)]
    docs = docs_frame(spark, rows)  # one value of lang: its part and an empty one for the rest
    train = [words_of(lower_az(t)) for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    pieces, prior = lattice_lm.vocabulary(path)
    texts = docs.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 10) <> 0").selectExpr("text", "0 as part")
    logs = lattice_lm.fitted(texts, pieces, prior, 2)
    weight = [dict(zip(pieces, np.exp(part))) for part in logs]

    def lattice(word, part):  # all segmentations of the word with its space mark
        raw = lattice_lm.SPACE + word.encode()
        ways = [1.0] + [0.0] * len(raw)
        for end in range(1, len(raw) + 1):
            ways[end] = sum(ways[i] * weight[part].get(raw[i:end], 0.0) for i in range(end) if not (0 < i < 3 and end > i + 1))
        return ways[-1]

    c = Counter(w for t in train for w in t)
    n, once = sum(c.values()), sum(v == 1 for v in c.values())
    escape, end, share = min(max((once + 1) / (n + 2), 1e-4), 1.0), (len(train) + 1) / (n + len(train) + 2), (len(train) + 1) / (len(train) + 2)
    for r in lattice_lm.scored(docs, path).collect():
        own = words_of(lower_az(dict(rows)[r.doc_id]))
        score = math.log10(share * end) + sum(math.log10(((1 - escape) * c[w] / n + escape * lattice(w, 0)) * (1 - end)) for w in own)
        pure = math.log10(share * end) + sum(math.log10(lattice(w, 0) * (1 - end)) for w in own)
        assert abs(r.score - score) < 1e-4 and abs(r.lattice_score - pure) < 1e-4
