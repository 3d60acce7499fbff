"""Language of texts, and of the spans of mixed texts.

*Model.*  Hashed byte n-grams of words (lower case, with their borders) are counted by language over a
bounded sample of labelled documents: at most about ``per_language`` of each language, drawn by a hash of
the id.  A word's score for a language is the sum of its n-grams' smoothed log probabilities.

*Script ranges.*  The script of a word's first letter, from ranges of code points, narrows the
languages: only those that were seen with that script in at least ``SCRIPT_SHARE`` of their words are
candidates, and a word of a script that none was seen with says nothing and counts for no language.

*Viterbi.*  The labels of all words of a text are those of the best path, where each switch of language
costs ``penalty``; runs of one label are the spans.  The text's language is the one with most letters'
bytes under its label, and the score is its share of them.  Texts of a batch are decoded in step.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every text if nothing
could be learned; a text of unseen scripts alone has score 0; labels that are null teach nothing, nor do
those beyond the ``MAX_LANGUAGES`` most frequent; a null doc_id is never held out and teaches nothing;
repeated rows are separate documents; an empty table gives no rows; other columns, whatever their names, are
carried along by `identified_documents` and not read by `identify`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import covered, uncovered
from .remembered import forget
from .words import raw_texts

UNDETERMINED = "und"
PER_LANGUAGE = 1500
#: Labels that the model learns, the most frequent ones first.
MAX_LANGUAGES = 400
FEATURES = 1 << 15
PENALTY = 12.0
SCRIPT_SHARE = 0.001
#: The least score at which the pipeline keeps a document.
LEAST_SCORE = 0.5
#: Words whose scores a worker remembers.
MEMORY = 100_000
#: New words that are scored at a time.
SCORED = 4_000

#: First and last code points of scripts, in order of code points (public Unicode blocks).
SCRIPTS = (
    (0x0041, 0x024F, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"), (0x0600, 0x077F, "arabic"), (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"),
    (0x0B80, 0x0BFF, "tamil"), (0x0C00, 0x0C7F, "telugu"), (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"),
    (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFF, "greek"), (0x3040, 0x309F, "hiragana"), (0x30A0, 0x30FF, "katakana"),
    (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"), (0x20000, 0x2FA1F, "han"),
)
NAMES = tuple(dict.fromkeys(name for _, _, name in SCRIPTS)) + ("other",)
_STARTS = np.array([a for a, _, _ in SCRIPTS])
#: ASCII characters that are no letters become blanks.
_LETTERS = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


def script_of(word: bytes) -> int:
    """Number of the script of the first letter; -1 without a letter."""
    if word.isascii():
        return 0 if word else -1
    letter = next((c for c in word.decode("utf-8", "replace") if c.isalpha()), None)
    if letter is None:
        return -1
    at = int(np.searchsorted(_STARTS, ord(letter), side="right")) - 1
    if at >= 0 and ord(letter) <= SCRIPTS[at][1]:
        return NAMES.index(SCRIPTS[at][2])
    return len(NAMES) - 1


def words_of(raw: bytes) -> list[bytes]:
    """Lower-case words of letters, for scores; what is no letter in ASCII parts them."""
    return raw.decode("utf-8", "replace").lower().encode().translate(_LETTERS).split()


def has_letter(raw: bytes, words: list[bytes]) -> bool:
    if raw.isascii():
        return bool(words)
    return any(w.isascii() for w in words) or any(map(str.isalpha, raw.decode("utf-8", "replace")))


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of 2 to 4 bytes of all words, and where each word's begin."""
    joined = np.frombuffer(b"".join(b"\x01%b\x02\x00\x00\x00" % w for w in words), np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 5
    ends = np.cumsum(lengths)
    code, found = joined.copy(), []
    for k in range(1, 4):
        code = code[:-1] | (joined[k:] << np.uint32(8 * k))
        # An n-gram that begins or ends in the blanks between words, which are too wide to be bridged, is
        # hashed to the last feature, which is not used: a word's score is its own.
        inside = (joined[k:] != 0) & (joined[:-k] != 0)
        hashed = ((code * np.uint32(0x9E3779B1) + np.uint32(k * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(17)) % np.uint32(FEATURES - 1)
        found.append(np.concatenate((np.where(inside, hashed, FEATURES - 1), np.full(k, FEATURES - 1))))
    return np.stack(found, axis=1), ends - lengths


class Model:
    """Log probabilities [feature, language] and the scripts of each language."""

    def __init__(self, languages: list[str], table: np.ndarray, scripts: np.ndarray):
        self.languages, self.table, self.scripts = languages, table, scripts

    @classmethod
    def of_counts(cls, languages: list[str], counts: np.ndarray, scripts: np.ndarray) -> Model:
        table = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * FEATURES)).T.astype(np.float32)
        table[-1] = 0
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        return cls(languages, np.ascontiguousarray(table), (share >= SCRIPT_SHARE).T)

    def scores(self, words: list[bytes]) -> np.ndarray:
        """[word, language and weight]; -inf for languages that the script rules out, 0 for words that say nothing.

        The weight is 1 for a word that has a candidate, 0.5 for one that has none, 0 for one without a letter.
        """
        found, starts = features(words)
        out = np.add.reduceat(self.table[found].sum(axis=1), starts, axis=0)
        kinds = np.fromiter(map(script_of, words), np.int64, len(words))
        allowed = self.scripts[kinds]
        out = np.where(allowed, out, -1e9)
        known = allowed.any(axis=1)
        out[(kinds < 0) | ~known] = 0
        weight = np.where(kinds < 0, 0, np.where(known, 1, 0.5))
        return np.column_stack((out, weight)).astype(np.float32)


class _Scores(dict):
    """Word to row of a table of scores; rows of new words are scored when asked for."""

    def __init__(self, model: Model):
        super().__init__()
        self._model, self._new = model, []
        self.rows = np.empty((0, len(model.languages) + 1), np.float32)

    def __missing__(self, word: bytes) -> int:
        row = self[word] = len(self)
        self._new.append(word)
        return row

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def score(self) -> np.ndarray:
        parts = [self.rows[: len(self) - len(self._new)]]
        for at in range(0, len(self._new), SCORED):
            parts.append(self._model.scores(self._new[at : at + SCORED]))
        self._new = []
        self.rows = np.concatenate(parts)
        return self.rows

    def trim(self) -> None:
        if len(self) > MEMORY:
            self.clear()
            self.rows = self.rows[:0]


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best labels of all words; texts lie one after the other, longest first, and are decoded in step."""
    labels = np.zeros(len(scores), np.int32)
    if not len(scores):
        return labels
    steps = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # texts with more words than the step
    value = scores[starts].copy()
    came, switched = [], []
    for t in range(1, steps):
        a = active[t]
        before = value[:a]
        best = before.argmax(axis=1)
        other = before[np.arange(a), best][:, None] - np.float32(penalty)
        switch = other > before
        came.append(best)
        switched.append(switch)
        value[:a] = np.where(switch, other, before) + scores[starts[:a] + t]
    state = value.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        a = active[t]
        own = state[:a]
        labels[starts[:a] + t] = own
        state[:a] = np.where(switched[t - 1][np.arange(a), own], came[t - 1], own)
    labels[starts] = state
    return labels


def _decode(raws: list[bytes], model: Model, memory: _Scores, spans: bool):
    """Per text: language number (-1: none), score, number of spans, and the spans if asked for."""
    language, score, runs = np.full(len(raws), -1), np.zeros(len(raws)), np.zeros(len(raws), np.int64)
    listed: list = [[] for _ in raws]
    held, places = [], []
    for k, raw in enumerate(raws):
        words = words_of(raw)
        if words and model.languages and has_letter(raw, words):
            held.append((memory.numbers(words), np.fromiter(map(len, words), np.int64, len(words))))
            places.append(k)
    rows = memory.score()
    order = sorted(range(len(held)), key=lambda i: -len(held[i][0]))
    limit = max(1 << 14, (1 << 22) // max(1, len(model.languages)))
    at = 0
    while at < len(order):
        slab, size = [], 0
        while at < len(order) and (not slab or size + len(held[order[at]][0]) <= limit and len(slab) < 512):
            slab.append(order[at])
            size += len(held[order[at]][0])
            at += 1
        lengths = np.array([len(held[i][0]) for i in slab])
        starts = np.cumsum(lengths) - lengths
        found = rows[np.concatenate([held[i][0] for i in slab])]
        labels = viterbi(np.ascontiguousarray(found[:, :-1]), starts, lengths)
        text = np.repeat(np.arange(len(slab)), lengths)
        sizes = np.concatenate([held[i][1] for i in slab])
        letters = np.bincount(text * len(model.languages) + labels, weights=sizes * (found[:, -1] == 1), minlength=len(slab) * len(model.languages))
        letters, every = letters.reshape(len(slab), -1), np.bincount(text, weights=sizes * (found[:, -1] > 0), minlength=len(slab))
        turn = np.concatenate(([True], labels[1:] != labels[:-1])) if len(labels) else np.empty(0, bool)
        turn[starts] = True
        own = np.array([places[i] for i in slab])
        language[own], score[own] = letters.argmax(axis=1), letters.max(axis=1) / np.maximum(every, 1)
        runs[own] = np.bincount(text[turn], minlength=len(slab))
        if spans:
            begins = np.nonzero(turn)[0]
            ends = np.append(begins[1:], len(labels))
            for b, e in zip(begins.tolist(), ends.tolist()):
                d = text[b]
                listed[places[slab[d]]].append({"lang": model.languages[labels[b]], "start": b - int(starts[d]), "end": e - int(starts[d])})
    memory.trim()
    return language, score, runs, listed


def held_out(doc_id: Column, fold: int = 2, folds: int = 4) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model:
    """Fit the model to labelled rows; at most about ``per_language`` documents of each language are read."""
    taught = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("doc_id is not null and text is not null and lang is not null")
    frequent = taught.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES)
    sizes = {r["lang"]: r["count"] for r in frequent.collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((FEATURES, 0), np.float32), np.zeros((len(NAMES), 0), bool))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    limit = F.element_at(F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, per_language / n))]), F.col("lang"))
    sample = taught.where(draw < limit)
    width = FEATURES + len(NAMES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {}
        for batch in batches:
            for raw, own in zip(raw_texts(batch.column(0)), batch.column(1).to_pylist()):
                if not (words := words_of(raw)):
                    continue
                into = totals.setdefault(own, np.zeros(width, np.int64))
                into[:FEATURES] += np.bincount(features(words)[0].reshape(-1), minlength=FEATURES)
                kinds = np.fromiter(map(script_of, words), np.int64, len(words))
                into[FEATURES:] += np.bincount(kinds[kinds >= 0], minlength=len(NAMES))
        for own, into in totals.items():
            at = np.nonzero(into)[0]
            yield pa.RecordBatch.from_arrays([pa.array([own] * len(at), pa.string()), pa.array(at), pa.array(into[at])], names=["lang", "feature", "times"])

    counted = sample.select("text", "lang").mapInArrow(count, "lang string, feature long, times long")
    rows = counted.groupBy("lang", "feature").agg(F.sum("times").alias("times")).toArrow()
    totals = np.zeros((len(languages), width))
    number = {name: k for k, name in enumerate(languages)}
    owners = np.fromiter((number[x] for x in rows["lang"].to_pylist()), np.int64, len(rows))
    totals[owners, rows["feature"].to_numpy()] = rows["times"].to_numpy()
    totals[:, FEATURES - 1] = 0
    return Model.of_counts(languages, totals[:, :FEATURES], totals[:, FEATURES:])


def identified(docs: DataFrame, model: Model, text: str = "text", spans: bool = False) -> DataFrame:
    """``docs`` with lang_pred, lang_score, n_spans and, if asked for, spans (words from start to end)."""
    table = docs.sparkSession.sparkContext.broadcast(model)
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("n_spans", T.LongType())]
    span = T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    kept = [f for f in docs.schema if f.name not in ("lang_pred", "lang_score", "n_spans", "spans")]
    schema = T.StructType(kept + added + ([T.StructField("spans", T.ArrayType(span))] if spans else []))
    at = [f.name for f in kept].index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        learned = table.value
        memory = _Scores(learned)
        labels = np.array([*learned.languages, UNDETERMINED], object)
        for whole in batches:
            for part in range(0, max(1, whole.num_rows), 2048):
                batch = whole.slice(part, 2048)
                language, score, runs, listed = _decode(list(raw_texts(batch.column(at))), learned, memory, spans)
                columns = [*batch.columns, pa.array(labels[language], pa.string()), pa.array(score), pa.array(runs)]
                if spans:
                    columns.append(pa.array(listed, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*[f.name for f in kept]).mapInArrow(run, schema)


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = PER_LANGUAGE) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, n_spans; learned from the documents not held out."""
    model = learn(docs.where(~held_out(F.col(doc_id))), text, lang, doc_id, per_language)
    found = identified(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "n_spans")


def identified_documents(docs: DataFrame, least: float = LEAST_SCORE, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """The documents that have a language with a score of at least ``least``, in their own columns."""
    model = learn(docs, text, lang, doc_id)
    rows, own = covered(docs)
    found = identified(rows, model, own[text]).where((F.col("lang_pred") != UNDETERMINED) & (F.col("lang_score") >= least))
    return uncovered(found, docs)
