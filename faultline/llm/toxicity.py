"""Toxicity with noisy-channel deobfuscation.

Writers hide words by leetspeak (``1d10t``), spacing (``i d i o t``) and
repetition (``idiooot``). Such spans are read as lattices of the characters
that may have been meant, and a Viterbi search under a character trigram model
of the whole corpus restores them; the path costs also decide whether a symbol
or a doubled letter (``worthle$$``, ``iiddiioott``) is meant as it stands. A
word of plain letters of which one is doubled (``iidiot``) is searched if the
corpus spells it far less often than without the second letter; its reading is
then put beside it, as it may be a rare word (``ass`` beside ``as``). Numbers and
one symbol repeated stay as they are. The restored text is scored by its words and word
beginnings: each has a log ratio between toxic and other training texts, and a
logistic model weighs a text's three strongest.

The counts of trigrams and of words (in 2^22 bins of their hash, so rare words
that share a bin count together) cover all documents. The ratios and the logistic model are
fitted on at most ``max_train`` labelled rows (a setting, the rows of least id
hash). Scoring reads every text once and shuffles nothing; labels, lang,
source and doc_id are no inputs of a score.

Defined cases: null or empty text has no evidence and gets the model's bias;
without a labelled row of each class the score is the share of toxic rows
(0.5 without any); repeated rows score alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import tokens
from faultline.llm.labelled import fit_logistic, held_out, logistic, sample_of, sampled_texts
from faultline.llm.storage import trimmed, written

#: The letters that a symbol may stand for.
LEET = {"@": "a", "4": "a", "8": "b", "(": "c", "3": "e", "6": "g", "9": "g", "1": "il", "!": "il", "|": "il", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "2": "z"}
#: Costs (natural log) of the channel's ways to write a letter.
COST_LEET, COST_REPEAT, COST_SPACED = 0.7, 0.3, 0.2
#: Costs of a letter doubled by mistake, of a symbol that is meant as one, and of a separator that is.
COST_DOUBLED, COST_SYMBOL, COST_APART = 2.0, 1.5, 0.5
#: What a letter doubled by mistake must cost for a word of the corpus to be taken for another one.
COST_SLIP = 4.0
CLASSES = 64
#: Byte classes of the character model: 0 for what is no letter, a-z, and the bytes beyond ASCII by their low bits.
CLASS_OF = np.zeros(256, np.int64)
CLASS_OF[97:123] = np.arange(1, 27)
CLASS_OF[65:91] = np.arange(1, 27)
CLASS_OF[128:] = 27 + (np.arange(128, 256) & 31)
IS_LETTER = CLASS_OF > 0
IS_LEET = np.zeros(256, bool)
IS_LEET[[ord(c) for c in LEET]] = True
BUCKETS = 1 << 22
#: Steps in which the log of a count is kept: a byte holds counts up to e^36.
SPELLED_STEPS = 7
BEGINNINGS = (4, 5, 6)
TOP = 3

LEET_SET = re.escape("".join(LEET))
#: A word with a symbol between, before or after letters; or doubled letters; or single characters set apart.
WORDLIKE = rf"[A-Za-z\x80-\U0010FFFF{LEET_SET}]"
#: Only words with something other than ASCII letters or with a doubled letter.
MIXED = re.compile(rf"(?<![^\s.,;:'\"?*_#&%-])(?=[A-Za-z]*?(?:[\x80-\U0010FFFF{LEET_SET}]|([A-Za-z])(?i:\1))){WORDLIKE}{{3,}}(?![^\s.,;:'\"?*_#&%-])")
DOUBLED = re.compile(r"([^\W\d_])\1", re.IGNORECASE)
#: A letter three times or two letters doubled: no plain spelling.
OFTEN = re.compile(r"([^\W\d_])\1(?:\1|.*([^\W\d_])\2)", re.IGNORECASE)
LETTERS = re.compile(r"[^\W\d_]+")
#: Digits with signs, a currency or marks of exclamation beside them.
NUMERIC = re.compile(r"[(+$|]*[0-9]+\$?[!+|]*")
#: Marks that often stand at a word's ends.
LEAD, TRAIL = re.compile(r"([!|(+$@])\1+"), re.compile(r"(?:([!|(+$@])\1+|!)$")
RUNS = re.compile(r"(.)\1*", re.DOTALL)
SPACED = re.compile(rf"(?<![\w@$]){WORDLIKE}(?:[ ._*-]{WORDLIKE}){{2,}}(?![\w@$])")


def trigram_and_word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of trigrams, and after these of the bins of lower-cased words."""
    total, spelled = np.zeros(CLASSES ** 3, np.int64), np.zeros(BUCKETS, np.int32)
    for batch in batches:
        for part in tokens.slices(batch, "text", 1 << 20):
            data, offsets = tokens.text_bytes(part.column("text"))
            if not len(data):
                continue
            # every text stands between non-letters
            at = np.arange(len(data)) + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) * 2 + 2
            c = np.zeros(len(data) + 2 * len(offsets) + 2, np.int64)
            c[at] = CLASS_OF[data]
            total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES ** 3)
            words = tokens.split_words(part.column("text"), True, ~(IS_LETTER | IS_LEET))
            bins, n = np.unique(bins_of(words), return_counts=True)
            spelled[bins] += n.astype(np.int32)
    for counts, first in ((total, 0), (spelled, CLASSES ** 3)):
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held + first), pa.array(counts[held].astype(np.int64))], names=["gram", "n"])


def bins_of(words: tokens.Words) -> np.ndarray:
    return (tokens.hash_words(words, 0) & np.uint64(BUCKETS - 1)).astype(np.int64)


def corpus_models(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """From one scan of all documents: log probabilities of a class after two others, interpolated with shorter contexts, and of each bin of words ``SPELLED_STEPS`` times the log of its count, rounded."""
    rows = docs.select("text").mapInArrow(trimmed(trigram_and_word_counts), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # at most CLASSES ** 3 + BUCKETS rows
    n = np.zeros(CLASSES ** 3 + BUCKETS)
    n[rows["gram"].to_numpy()] = rows["n"].to_numpy()
    spelled = np.rint(SPELLED_STEPS * np.log1p(n[CLASSES ** 3:])).astype(np.uint8)
    return _log_trigrams(n[:CLASSES ** 3].reshape(CLASSES, CLASSES, CLASSES)), spelled


def character_model(docs: DataFrame) -> np.ndarray:
    return corpus_models(docs)[0]


def _log_trigrams(n: np.ndarray) -> np.ndarray:
    n[0, 0, 0] = 0  # runs of non-letters say nothing about words
    one = (n.sum((0, 1)) + 1) / (n.sum() + CLASSES)
    two = (n.sum(0) + 5 * one) / (n.sum((0, 2))[:, None] + 5)
    return np.log((n + 5 * two[None]) / (n.sum(2, keepdims=True) + 5))


class Decoder:
    """Viterbi search over the character lattices of one span, with a bounded memory of spans."""

    def __init__(self, model: np.ndarray, spelled: np.ndarray | None = None, most: int = 200_000):
        """``spelled`` are the counts of words as ``corpus_models`` gives them; without them a word with one doubled letter stands."""
        self.model, self.spelled, self.most, self.known = model, spelled, most, {}

    def _kept(self, key, value):
        if key not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[key] = value()
        return self.known[key]

    def restore(self, span: str) -> str:
        return self._kept(span, lambda: "".join(self._search(span.lower())[1]))

    def word(self, span: str) -> str:
        """A word as the search reads it. Marks at an end are read with the rest or stand beside it as a symbol, whichever costs less."""
        return self._kept((span,), lambda: self._word(span))

    def _log_count(self, word: str) -> int:
        return int(self.spelled[tokens.hash_word(word.encode()) & BUCKETS - 1])

    def _may_be_slip(self, word: str) -> bool:
        """Whether the corpus spells a word with one doubled letter far less often than without its second."""
        low = word.lower()
        return self.spelled is not None and self._log_count(low) + COST_SLIP * SPELLED_STEPS < self._log_count(DOUBLED.sub(r"\1", low))

    def _plain(self, word: str, parts: list[str]) -> str:
        """The reading of a word of letters; beside the word where only one letter is doubled."""
        meant = "".join(parts)
        if OFTEN.search(word):
            return meant
        return f"{word} {meant}" if meant != word.lower() and self._may_be_slip(word) else word

    def _word(self, span: str) -> str:
        if span.isalpha() and not OFTEN.search(span) and not self._may_be_slip(span):
            return span
        lead, trail = LEAD.match(span), TRAIL.search(span)
        begins = [0, lead.end()] if lead else [0]
        ends = [len(span), trail.start()] if trail else [len(span)]
        ways = [(i, j, *self._search(span[i:j].lower())) for i in begins for j in ends if i < j]
        i, j, _, parts = min(ways, key=lambda x: (x[2] + COST_SYMBOL * ((x[0] > 0) + (x[1] < len(span))), x[1] - x[0]))
        core = span[i:j]
        of = [m[0][0] for m in RUNS.finditer(core.lower())]
        # all symbols and separators are taken as such: the letters between them are words of their own
        stands = all(x == " " or (x == "" and k in (0, len(of) - 1)) for k, (c, x) in enumerate(zip(of, parts)) if c in LEET or not c.isalpha())
        if stands and not core.isalpha():
            meant = LETTERS.sub(lambda m: reading(m[0], self) if m[0].isalpha() else m[0], core)
        else:
            meant = core if not searched(core) else self._plain(core, parts) if core.isalpha() else "".join(parts)
        return span[:i] + meant + span[j:]

    @staticmethod
    def lattice(span: str) -> list[list[tuple[str, float]]]:
        """For each run of equal characters, what it may mean and at which cost; '' for nothing meant."""
        units, i = [], 0
        while i < len(span):
            c, j = span[i], i
            while j < len(span) and span[j] == c:
                j += 1
            n = j - i
            if c in LEET:
                ways = [(x, COST_LEET + COST_REPEAT * (n > 1)) for x in LEET[c]] + [(x * 2, COST_LEET * 2) for x in LEET[c] if n > 1]
                ways.append((" ", COST_SYMBOL))
            elif c.isalpha():
                ways = [(c, 0.0 if n == 1 else COST_DOUBLED if n == 2 else COST_REPEAT)] + [(c * 2, COST_REPEAT * (n > 2))] * (n > 1)
            else:
                ways = [("", COST_SPACED), (" ", COST_APART)]
            units.append(ways)
            i = j
        return units

    def _search(self, span: str) -> tuple[float, list[str]]:
        states = {(0, 0): (0.0, None)}
        for ways in self.lattice(span):
            after: dict = {}
            for (a, b), (cost, path) in states.items():
                for text, extra in ways:
                    x, y, total = a, b, cost + extra
                    for byte in text.encode():
                        z = int(CLASS_OF[byte])
                        total -= self.model[x, y, z]
                        x, y = y, z
                    if (x, y) not in after or total < after[x, y][0]:
                        after[x, y] = (total, (path, text))
            states = after
        best = min(states, key=lambda s: states[s][0] - self.model[s[0], s[1], 0])
        parts, path = [], states[best][1]
        while path is not None:
            path, text = path
            parts.append(text)
        return states[best][0] - self.model[best[0], best[1], 0], parts[::-1]


def searched(word: str) -> bool:
    """Whether the decoder looks at a word: one of several kinds of characters, or of letters of which one is doubled.

    Numbers and one symbol repeated are no words.
    """
    if word.isalpha():
        return DOUBLED.search(word) is not None
    return not NUMERIC.fullmatch(word) and word.count(word[0]) < len(word)


def reading(word: str, decoder: Decoder) -> str:
    return decoder.word(word) if searched(word) else word


def restored(text: str, decoder: Decoder) -> str:
    """The text with obfuscated spans as the search reads them."""
    text = SPACED.sub(lambda m: decoder.restore(m[0]), text)
    return MIXED.sub(lambda m: reading(m[0], decoder), text)


#: ASCII characters after which no character is set apart.
IS_JOINED = np.zeros(256, bool)
IS_JOINED[[b for b in range(128) if chr(b).isalnum() or chr(b) in "_@$"]] = True
IS_DIGIT = np.zeros(256, bool)
IS_DIGIT[48:58] = True
#: ASCII characters that a word may stand beside.
IS_EDGE = np.zeros(256, bool)
IS_EDGE[[b for b in range(128) if chr(b).isspace() or chr(b) in ".,;:'\"?*_#&%-"]] = True
IS_GAP = np.zeros(256, bool)
IS_GAP[np.frombuffer(b" ._*-", np.uint8)] = True


def _words_and_apart(column: pa.Array) -> tuple[tokens.Words, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Words that may be no plain ones: their places, the distinct ones, which of these each is; texts' offsets; where characters are set apart."""
    data, offsets = tokens.text_bytes(column)
    letter, leet = IS_LETTER[data], IS_LEET[data]
    low = tokens.LOWER[data]
    # words without a symbol beside a letter or another symbol, a letter twice or a character beyond ASCII are plain
    sign = data >= 128
    other = (low[1:] != low[:-1]) & ~(IS_DIGIT[data[1:]] & IS_DIGIT[data[:-1]])
    sign[1:] |= other & (leet[1:] & (letter | leet)[:-1] | leet[:-1] & letter[1:])
    sign[1:] |= (low[1:] == low[:-1]) & letter[1:]
    words = tokens.split_words(column, False, ~(IS_LETTER | IS_LEET))
    # a sign is the second of two: where they are of two texts, it may come before its text's word
    some = np.unique(np.searchsorted(words.starts, np.flatnonzero(sign), "right") - 1)
    some = some[(some >= 0) & (words.ends[some] - words.starts[some] >= 3)]
    chosen = tokens.Words(data, words.starts[some], words.ends[some], words.first)
    _, first, place = np.unique(tokens.hash_words(chosen, 0), return_index=True, return_inverse=True)
    distinct = [bytes(data[i:j]).decode() for i, j in zip(chosen.starts[first].tolist(), chosen.ends[first].tolist())]
    # three characters between single separators, by code points
    chars = np.flatnonzero(data & 0xC0 != 0x80)
    w = np.zeros(len(chars) + 4, bool)
    w[:-4] = (letter | leet)[chars]
    gap = np.zeros(len(chars) + 4, bool)
    gap[:-4] = IS_GAP[data[chars]]
    apart = np.flatnonzero(w[:-4] & gap[1:-3] & w[2:-2] & gap[3:-1] & w[4:])
    before = chars[apart] - 1
    begins = offsets[np.searchsorted(offsets, before + 1)] == before + 1
    return chosen, distinct, place, offsets, chars[apart[begins | ~IS_JOINED[data[before]]]]


def may_be_obfuscated(column: pa.Array) -> np.ndarray:
    """Texts that hold a span which ``restored`` sends to the search: a word that is no plain one, or three characters set apart.

    Words are told apart by the rule of ``restored`` itself, each distinct one once; what stands beside a word is not looked at.
    """
    words, distinct, place, offsets, apart = _words_and_apart(column)
    sent = np.fromiter(map(searched, distinct), bool, len(distinct))[place]
    out = np.zeros(len(column), bool)
    out[np.searchsorted(offsets, np.concatenate([words.starts[sent], apart]), "right") - 1] = True
    return out


def restored_column(column: pa.Array, decoder: Decoder) -> pa.Array:
    """``restored`` of every text; words are read once each, and put where they stand if nothing else can be meant."""
    words, distinct, place, offsets, apart = _words_and_apart(column)
    data = words.data
    read = [reading(x, decoder) for x in distinct]
    # spaces beyond ASCII split a word that ends beside other signs
    plain = np.fromiter((x.isascii() or x.isalpha() for x in distinct), bool, len(distinct))
    changed = np.fromiter((x != y for x, y in zip(distinct, read)), bool, len(distinct)) | ~plain
    own = np.flatnonzero(changed[place])
    text_of = np.searchsorted(offsets, words.starts[own], "right") - 1
    whole = np.zeros(len(column), bool)
    whole[np.searchsorted(offsets, apart, "right") - 1] = True
    whole[text_of[~plain[place[own]]]] = True
    begin, end = words.starts[own], words.ends[own]
    free = (begin == offsets[text_of]) | IS_EDGE[data[begin - 1]]
    free &= (end == offsets[text_of + 1]) | IS_EDGE[data[np.minimum(end, len(data) - 1)]]
    own, text_of = own[free & ~whole[text_of]], text_of[free & ~whole[text_of]]
    if not (len(own) or whole.any()):
        return column
    texts = column.to_pylist()
    for i in np.flatnonzero(whole):
        texts[i] = restored(texts[i], decoder)
    cuts = np.flatnonzero(np.diff(text_of, prepend=-1, append=-1)).tolist() if len(own) else []
    begin, end, which, raw = words.starts[own].tolist(), words.ends[own].tolist(), place[own].tolist(), data.tobytes()
    for i, j in zip(cuts[:-1], cuts[1:]):
        at, parts = int(offsets[text_of[i]]), []
        for k in range(i, j):
            parts += [raw[at:begin[k]], read[which[k]].encode()]
            at = end[k]
        parts.append(raw[at:int(offsets[text_of[i] + 1])])
        texts[text_of[i]] = b"".join(parts).decode()
    return pa.array(texts, column.type)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) of every word and word beginning of restored texts."""
    words = tokens.split_words(column, True, tokens.NOT_ALNUM)
    text = words.text_of
    length = words.ends - words.starts
    parts, owners = [tokens.hash_words(words, 0)], [text]
    for n in BEGINNINGS:
        longer = length > n
        cut = tokens.Words(words.data, words.starts[longer], words.starts[longer] + n, words.first)
        parts.append(tokens.mix64(tokens.hash_words(cut, 0) + np.uint64(n)))
        owners.append(text[longer])
    return (np.concatenate(parts) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate(owners)


def _distinct(feature: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(owner * BUCKETS + feature)
    return both % BUCKETS, both // BUCKETS


def _counter(sent):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(*sent.value)
        for part in tokens.gathered(batches, "text"):
            label = part.column("label").to_numpy()
            feature, owner = _distinct(*features(restored_column(part.column("text"), decoder)))
            for y in (0, 1):
                values, n = np.unique(feature[label[owner] == y], return_counts=True)
                zero = np.zeros(len(values), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(zero if y else n.astype(np.int64)), pa.array(n.astype(np.int64) if y else zero)], names=["feature", "n0", "n1"])
    return trimmed(count)


def log_ratio(n0, n1, all0: int, all1: int):
    return np.log((n1 + 0.5) / (all1 + 1.0)) - np.log((n0 + 0.5) / (all0 + 1.0)) - 1.0 / np.maximum(n1, 0.5)


def strongest(feature: np.ndarray, owner: np.ndarray, value: np.ndarray, texts: int) -> np.ndarray:
    """The ``TOP`` largest positive values of each text, each feature once."""
    out = np.zeros((texts, TOP))
    strong = value > 0
    feature, owner, value = feature[strong], owner[strong], value[strong]
    if len(feature):
        _, once = np.unique(owner * BUCKETS + feature, return_index=True)
        owner, value = owner[once], value[once]
        order = np.lexsort((-value, owner))
        owner, value = owner[order], value[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        keep = rank < TOP
        out[owner[keep], rank[keep]] = value[keep]
    return out


class Model:
    def __init__(self, characters: np.ndarray, ratio: np.ndarray, weight: np.ndarray, spelled: np.ndarray | None = None):
        self.characters, self.ratio, self.weight, self.spelled = characters, ratio, weight, spelled

    def scores(self, column: pa.Array, decoder: Decoder) -> np.ndarray:
        feature, owner = features(restored_column(column, decoder))
        top = strongest(feature, owner, self.ratio[feature], len(column))
        return logistic(top @ self.weight[:-1] + self.weight[-1])


def _evidence(sent):
    """A training text's strongest features, with its own counts taken off first."""
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        characters, spelled, n0, n1, all0, all1 = sent.value
        decoder = Decoder(characters, spelled)
        for part in tokens.gathered(batches, "text"):
            label = part.column("label").to_numpy()
            feature, owner = features(restored_column(part.column("text"), decoder))
            y = label[owner]
            own1 = n1[feature] - (y == 1)
            value = np.where(own1 > 0, log_ratio(np.maximum(n0[feature] - (y == 0), 0), np.maximum(own1, 0), all0, all1), 0.0)
            top = strongest(feature, owner, value, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("label"), *(pa.array(top[:, k]) for k in range(TOP))], names=["label", *(f"top{k}" for k in range(TOP))])
    return trimmed(weigh)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, max_train: int = 20_000) -> Model:
    context = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    characters, spelled = corpus_models(docs)
    texts = written(sampled_texts(docs, sample_of(labels, label, folds, max_train)), "toxicity-sample")  # at most max_train rows, read three times
    sizes = {r[0]: r[1] for r in texts.groupBy("label").count().collect()}
    all0, all1 = sizes.get(0, 0), sizes.get(1, 0)
    counts = texts.mapInArrow(_counter(context.broadcast((characters, spelled))), "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    rows = counts.where("n1 > 0").toArrow()  # at most BUCKETS rows
    n0, n1 = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    n0[rows["feature"].to_numpy()], n1[rows["feature"].to_numpy()] = rows["n0"].to_numpy(), rows["n1"].to_numpy()
    weight = np.zeros(TOP + 1)
    if not (all0 and all1):
        share = (all1 + 0.5) / (all0 + all1 + 1)
        weight[-1] = np.log(share / (1 - share))
    else:
        sent = context.broadcast((characters, spelled, n0, n1, all0, all1))
        names = [f"top{k}" for k in range(TOP)]
        top = texts.mapInArrow(_evidence(sent), "label int, " + ", ".join(f"{c} double" for c in names)).toArrow()  # at most max_train rows
        weight = fit_logistic(np.column_stack([top[c].to_numpy() for c in names]), top["label"].to_numpy().astype(float), ridge=0.1)
    ratio = np.where(n1 > 0, log_ratio(n0, n1, all0, all1), 0.0).astype(np.float32)
    return Model(characters.astype(np.float32), ratio, weight, spelled)


def _scorer(sent, columns: list[str], name: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        decoder = Decoder(model.characters, model.spelled)
        for batch in batches:
            for part in tokens.slices(batch, "text", 2 << 20):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(model.scores(part.column("text"), decoder), pa.float64())], names=[*columns, name])
    return trimmed(score)


def score(docs: DataFrame, model: Model, keep: list[str], name: str = "score") -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, and its score as ``name`` (which isn't one of them)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = docs.select(*keep).schema.add(name, "double")
    return rows.mapInArrow(_scorer(sent, keep, name), schema)


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, folds: int = 5, max_train: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    out = score(docs, train(docs, labels, "toxic", folds, max_train), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
