"""Fingerprints, scorers and the pipeline: brute force where there is one, else accuracy on rows kept from training."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from helpers import as_tuples, docs_frame, lower_az, words_of
from pyspark.sql import functions as F

import corpus_pipeline
from faultline.llm import decontaminate, fingerprints, lattice_lm, quality, tokens, toxicity
from faultline.llm.storage import table

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


# --- fingerprints ----------------------------------------------------------------


def spark_hash(*values):
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else (v & (1 << 64) - 1).to_bytes(8, "little")
        seed = xxhash.xxh64_intdigest(data, seed)
        seed = seed - (1 << 64) if seed >> 63 else seed
    return seed


def winnowed_plainly(units, k, w):
    h = [spark_hash(u) for u in units]
    if not h:
        return []
    # a position beyond the end adds nothing to a hash, as a null does
    g = [spark_hash(*h[i:i + k]) for i in range(max(len(h) - k + 1, 1))]
    chosen = []
    for i in range(max(len(g) - w + 1, 1)):
        window = range(i, min(i + w, len(g)))
        best = min(window, key=lambda p: (g[p], -p))
        if best not in chosen:
            chosen.append(best)
    return [(p, g[p]) for p in chosen]


def fingerprint_plainly(text):
    units = [u for w in words_of(text) for u in ([w] if len(w) <= fingerprints.LONG_WORD else w)]
    return (winnowed_plainly(units, fingerprints.WORDS_K, fingerprints.WORDS_W),
            winnowed_plainly(list(text), fingerprints.CHARS_K, fingerprints.CHARS_W) if len(text) <= fingerprints.SHORT else None)


def like_plainly(x, y):
    a, b = (x[1], y[1]) if x[1] is not None and y[1] is not None else (x[0], y[0])
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark):
    draw = random.Random(2)
    texts = [" ".join(draw.choice(["a", "b", "é", "word", "ñandú", "longer"]) for _ in range(draw.choice([1, 3, 8, 40, 300]))) for _ in range(40)]
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, " \t "), (503, "same " * 500), (504, "é" * 50), (1000, texts[3])]
    got = {r.doc_id: r for r in fingerprints.compared(docs_frame(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for (d, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after, r = t or "", after or "", got[d]
        third = len(t) // 3
        other = t[:len(t) - third] + after[:third]
        assert r.n_chars == len(t)
        import hashlib
        assert r.edited_sha256 == hashlib.sha256(other.encode()).hexdigest()
        own, changed, follows = map(fingerprint_plainly, (t, other, after))
        for found, expected in ((r.fingerprint, own), (r.edited_fingerprint, changed)):
            assert [(p.place, p.hash) for p in found.words] == expected[0]
            assert (found.chars is None) == (expected[1] is None) and [(p.place, p.hash) for p in found.chars or []] == (expected[1] or [])
        assert r.near_edited == pytest.approx(like_plainly(own, changed)) and r.near_next == pytest.approx(like_plainly(own, follows))


def test_fingerprints_of_odd_tables(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "x"), (None, None), (2, "y z")]
    out = fingerprints.compared(docs_frame(spark, rows)).collect()
    assert len(out) == 5 and len({str(r.fingerprint) for r in out if r.doc_id == 1}) == 1
    alone = fingerprints.compared(docs_frame(spark, [(1, "one text alone here")])).first()
    assert alone.near_next == 1.0
    assert fingerprints.compared(docs_frame(spark, rows).limit(0)).count() == 0


# --- classifiers -----------------------------------------------------------------


def held_accuracy(out, labels, label):
    rows = out.join(labels.select("doc_id", label), "doc_id").where("held_out").collect()
    assert len(rows) > 50
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    return sum(r.predicted == r[label] for r in rows) / len(rows)


def test_classifiers_on_rows_kept_from_training(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    assert held_accuracy(quality.judged(docs, labels), labels, "quality") >= 0.95
    assert held_accuracy(toxicity.judged(docs, labels), labels, "toxic") >= 0.95


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_of_odd_texts(spark, module):
    rows = [(i, "fine words of calm prose " + str(i)) for i in range(40)] + [(100 + i, "you idiot $$$ scum " + str(i)) for i in range(40)]
    rows += [(300, None), (301, ""), (None, "no id"), (302, "é" * 100_000), (302, "é" * 100_000), (303, "\x00\x01 ###")]
    labels = spark.createDataFrame([(d, int(d < 100), int(d >= 100)) for d in range(140)] + [(None, 1, 1), (5, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
    frame = docs_frame(spark, rows)
    got = module.judged(frame, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[300] == by[301] and not next(r for r in got if r.doc_id is None).held_out
    good, bad = [by[i] for i in range(40)], [by[100 + i] for i in range(40)]
    assert min(good) > max(bad) if module is quality else max(good) < min(bad)
    for some in (labels.limit(0), labels.where("quality = 1")):
        assert len({round(r.score, 9) for r in module.judged(frame, some).collect()}) == 1
    assert module.judged(frame.limit(0), labels).count() == 0


def test_deobfuscation(spark):
    plain = "you are an idiot and a loser, a stupid clown; such trash is pathetic and worthless, moron, disgusting scum. the good words of others " * 20
    frame = docs_frame(spark, [(1, plain), (2, "calm words of good prose with a thing in it " * 20), (3, None)])
    decoder = toxicity.Decoder(toxicity.character_model(frame))
    for hidden, meant in [("1d10t", "idiot"), ("i d i o t", "idiot"), ("idiooooot", "idiot"), ("l0ser", "loser"), ("$tup1d", "stupid"), ("c-l-o-w-n", "clown"), ("tr@sh", "trash"),
                          ("p@th3t1c", "pathetic"), ("m0r0n", "moron"), ("S C U M", "scum")]:
        assert meant in toxicity.restored(f"the {hidden}, and", decoder).lower(), hidden
        assert toxicity.may_be_obfuscated(pa.array([f"the {hidden}, and"]))[0]
    for kept in ("plain words, all good!", "THE!! GOOD!! WORDS!!", "in a 1 of", "call 555-1234", "words$$$ and### more***", ""):
        assert toxicity.restored(kept, decoder) == kept


def test_texts_with_a_disguised_word_alone_are_searched(spark):
    plain = "you are an idiot and worthless, some hate the calm and good words of others " * 20
    decoder = toxicity.Decoder(toxicity.character_model(docs_frame(spark, [(1, plain)])))
    ratio = np.zeros(toxicity.BUCKETS, np.float32)
    ratio[toxicity.features(pa.array(["hate idiot worthless"]))[0]] = 3.0
    model = toxicity.Model(decoder.model, ratio, np.array([1.0, 1.0, 1.0, -5.0]))
    for hidden, meant in [("hat3", "hate"), ("idi07", "idiot"), ("worthle55", "worthless")]:
        for text in ("the {} and", "{}", "and {}."):
            assert model.scores(pa.array([text.format(hidden)]), decoder) == pytest.approx(model.scores(pa.array([text.format(meant)]), decoder)), hidden
    calm = model.scores(pa.array(["good words", "good words!", "good (words)"]), decoder)
    assert calm.max() == pytest.approx(calm.min()) and calm.max() < 0.01

    class Spy:
        def restore(self, span):
            self.met = True
            return span

        word = restore

    draw = random.Random(5)
    for _ in range(3000):
        text = "".join(draw.choice("aabBé日“—  .-_*,!!$$(13+0)@") for _ in range(draw.randrange(1, 12)))
        spy = Spy()
        spy.met = False
        toxicity.restored(text, spy)
        assert not spy.met or toxicity.may_be_obfuscated(pa.array(["x", text, None]))[1], text


def test_words_of_few_or_doubled_letters_are_searched(spark):
    plain = "you are an idiot and worthless, such trash is a loss. the good words of others and all well meant small letters " * 20
    decoder = toxicity.Decoder(toxicity.character_model(docs_frame(spark, [(1, plain)])))
    ratio = np.zeros(toxicity.BUCKETS, np.float32)
    ratio[toxicity.features(pa.array(["idiot worthless trash"]))[0]] = 3.0
    model = toxicity.Model(decoder.model, ratio, np.array([1.0, 1.0, 1.0, -5.0]))
    for hidden, meant in [("1d107", "idiot"), ("iiddiioott", "idiot"), ("IiDdIiOoTt", "idiot"), ("worthle$$", "worthless"), ("7r45h", "trash")]:
        assert model.scores(pa.array([f"the {hidden} and"]), decoder) == pytest.approx(model.scores(pa.array([f"the {meant} and"]), decoder)), hidden
    for kept in ("all good, small letters", "well!! meant! good! tall!", "1007 $100 455 +49 2024!", "$$$ !!! +++"):
        assert toxicity.restored(kept, decoder) == kept
    # whole columns are read as their texts are
    draw = random.Random(6)
    some = ["idi07", "1d107", "good", "all!", "iiddiioott", "worthle$$", "é", "éééa", "“loss”", "a\u00a0b3c", ")", "(", " ", " ", " ", "_", ".", "i d i o t", "1007", "日本", "/"]
    texts = [None, "", *("".join(draw.choice(some) for _ in range(draw.randrange(1, 9))) for _ in range(1500))]
    assert toxicity.restored_column(pa.array(texts), decoder).to_pylist() == [t and toxicity.restored(t, decoder) for t in texts]


def test_one_doubled_letter_is_read_by_the_corpus_spellings(spark):
    plain = "you are an idiot and a loser as all good small letters of the committee tell " * 400 + "an ass and an iidiot or a losser. " + "a hall and a ball, " * 50
    characters, spelled = toxicity.corpus_models(docs_frame(spark, [(1, plain), (2, None), (3, "")]))
    decoder = toxicity.Decoder(characters, spelled)
    for word in ("", "a", "iidiot", "é日", "x" * 63, "y" * 70_000):
        assert tokens.hash_word(word.encode(), 3) == tokens.hash_words(tokens.Words(np.frombuffer(word.encode(), np.uint8), np.zeros(1, np.int64), np.array([len(word.encode())]), np.array([0, 1])), 3)[0]
    words = collections.Counter(w for w in plain.replace(".", " ").replace(",", " ").split())
    for word, n in words.items():
        assert abs(decoder._log_count(word) / toxicity.SPELLED_STEPS - math.log1p(n)) < 0.08, word
    for hidden, meant in [("iidiot", "idiot"), ("losser", "loser"), ("idiott", "idiot"), ("looser", "loser")]:
        assert toxicity.restored(f"the {hidden}, and", decoder) == f"the {hidden} {meant}, and"
        assert toxicity.may_be_obfuscated(pa.array([f"the {hidden} and"]))[0]
    # a rare word stays where its reading is put beside it; frequent ones and unknown ones stand
    assert "ass" in toxicity.restored("an ass", decoder).split()
    for kept in ("all good", "Small letters tell", "a hall or ball", "committee", "xyyz", "GOOD!"):
        assert toxicity.restored(kept, decoder) == kept, kept
    draw = random.Random(8)
    some = ["iidiot", "Idiott", "all", "good!", "losser", "é", " ", " ", " ", ".", "ééa", "1d107"]
    texts = [None, "", *("".join(draw.choice(some) for _ in range(draw.randrange(1, 9))) for _ in range(500))]
    assert toxicity.restored_column(pa.array(texts), decoder).to_pylist() == [t and toxicity.restored(t, decoder) for t in texts]
    ratio = np.zeros(toxicity.BUCKETS, np.float32)
    ratio[toxicity.features(pa.array(["idiot"]))[0]] = 3.0
    model = toxicity.Model(characters, ratio, np.array([1.0, 1.0, 1.0, -5.0]), spelled)
    hidden, meant, calm = model.scores(pa.array(["the iidiot and", "the idiot and", "all good"]), decoder)
    assert hidden == pytest.approx(meant) and calm < 0.01
    assert toxicity.corpus_models(docs_frame(spark, [(1, None)]))[1].max() == 0


def test_viterbi_finds_the_cheapest_path(spark):
    model = np.log(np.random.default_rng(4).dirichlet(np.ones(toxicity.CLASSES), (toxicity.CLASSES, toxicity.CLASSES)))
    decoder = toxicity.Decoder(model)

    def cost(parts):
        a = b = 0
        total = sum(c for _, c in parts)
        for byte in "".join(t for t, _ in parts).encode() + b" ":
            z = int(toxicity.CLASS_OF[byte])
            total -= model[a, b, z]
            a, b = b, z
        return total

    for span in ("1d10t", "a.b.c", "ll0oo", "@1"):
        best = min(itertools.product(*decoder.lattice(span)), key=cost)
        assert decoder.restore(span) == "".join(t for t, _ in best)


# --- language model --------------------------------------------------------------


def test_lattice_sums_all_segmentations():
    pieces = [lattice_lm.SPACE + b"a", lattice_lm.SPACE, b"a", b"b", b"ab", b"ba", b"abb", lattice_lm.SPACE + b"ab", *(bytes([b]) for b in lattice_lm.SPACE)]
    draw = np.random.default_rng(1)
    p = draw.dirichlet(np.ones(len(pieces)))
    lattice = lattice_lm.Lattice(pieces, np.log(np.stack([p[::-1], p])))

    def every(rest):
        if not rest:
            yield 1.0, collections.Counter()
        for i, piece in enumerate(pieces):
            if rest.startswith(piece):
                for q, used in every(rest[len(piece):]):
                    yield p[i] * q, used + collections.Counter([i])

    texts = ["a", "abba", "ab b ababb", "bbb"]
    words = tokens.hashed_words(pa.array(texts))
    chosen = np.arange(len(words.starts))
    uses = np.zeros(len(pieces))
    logs = lattice.log_probabilities(words, chosen)[1]
    lattice.count(words, chosen, np.full(len(chosen), 2.0), uses, 1)
    expected = np.zeros(len(pieces))
    for i, word in enumerate(w for t in texts for w in words_of(t)):
        paths = list(every(lattice_lm.SPACE + word.encode()))
        total = sum(q for q, _ in paths)
        assert logs[i] == pytest.approx(math.log(total))
        for q, used in paths:
            for j, n in used.items():
                expected[j] += 2.0 * q / total * n
    assert uses == pytest.approx(expected)


def test_language_model_counts(spark):
    draw = random.Random(8)
    rows = [(i, " ".join(draw.choice(["The", "a", "wörd", "x9", f"n{draw.randrange(400)}"]) for _ in range(draw.randrange(1, 40)))) for i in range(300)]
    rows += [(400, None), (401, ""), (3, rows[3][1]), (402, "z" * 70_000), (403, "unseen\ntoken")]
    got = lattice_lm.scored(docs_frame(spark, rows), PIECES, rounds=1).collect()
    lists = {d: words_of(lower_az(t)) for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows}
    c = collections.Counter()
    for d, t in rows:
        if not held[d]:
            c.update([*words_of(lower_az(t)), None])
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for r in got:
        own = [*lists[r.doc_id], None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(c[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
        assert math.isfinite(r.score) and r.score < 0
    assert lattice_lm.scored(docs_frame(spark, rows).limit(0), PIECES).count() == 0
    assert lattice_lm.scored(docs_frame(spark, [(d, t) for d, t in rows if held[d]]), PIECES, rounds=1).where("n_known = 0").count() == sum(held[d] for d, _ in rows)


def test_language_model_is_the_same_for_any_partitions(spark):
    draw = random.Random(9)
    rows = [(i, " ".join(draw.choice(["the", "wording", "wörd", f"n{draw.randrange(60)}"]) for _ in range(30))) for i in range(200)]
    few, many = ({r.doc_id: r.score for r in lattice_lm.scored(docs_frame(spark, rows, n), PIECES).collect()} for n in (2, 50))
    assert few == pytest.approx(many, rel=1e-5)
    # pieces are used as often as the words that hold them
    pieces, logs = lattice_lm.vocabulary(PIECES)
    one, two = (lattice_lm.fitted(docs_frame(spark, [(1, "wording " * n + "zebra")]).withColumn("part", F.lit(0)), pieces, logs, 1)[0] for n in (1, 500))
    assert max(two - one) > 1.0


def test_model_beats_the_base_on_known_text(spark):
    out = lattice_lm.scored(table(spark, "/root/testdata/sf0.01", "documents"), PIECES)
    train = out.where("not held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert train[0] > train[1]


# --- pipeline --------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    before = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == columns
        kept[name] = (as_tuples(before, "doc_id", "text"), as_tuples(after, "doc_id", "text"))
        before = after
    was, now = map(dict, kept["toxicity"])
    assert set(now.items()) <= set(was.items()) and len(now) > 0.8 * len(was)
    was, now = map(dict, kept["near copies"])
    assert set(now.items()) <= set(was.items())
    # a document of each group stays, and no two that stay are near copies
    from test_exact_operators import near_plainly
    groups = {d: g for d, _, g in near_plainly(list(was.items()))}
    assert set(now) == set(groups.values())
    was, now = map(dict, kept["repeated passages"])
    seen = set()
    for d in sorted(was):
        w = words_of(was[d])
        gone = set()
        for s in range(len(w) - 19):
            k = tuple(w[s:s + 20])
            if k in seen:
                gone.update(range(s, s + 20))
            seen.add(k)
        if len(gone) < len(w) or not w:
            assert now[d] == (was[d] if not gone else " ".join(x for i, x in enumerate(w) if i not in gone))
        else:
            assert d not in now
    was, now = kept["benchmark"]
    from test_exact_operators import judged_plainly
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    clean = {d for d, _, _, _, hit in judged_plainly(was, items) if not hit}
    assert {d for d, _ in now} == clean
    out = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert out.columns == [*columns, "copy"] and out.where("copy not in (1, 2)").count() == 0
    assert decontaminate.judge(out, table(spark, SF, "benchmark")).where("contaminated").count() == 0


def test_pipeline_of_odd_tables(spark):
    docs = docs_frame(spark, [(1, None), (2, ""), (None, "a b c"), (3, "one text " * 30), (3, "one text " * 30)])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        assert stage(spark, docs, SF).columns[:len(docs.columns)] == docs.columns
