"""Each operator against brute force, round trips and the cases that its docstring defines."""

import collections
import gzip
import io
import random
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from pyspark.sql import functions as F
from conftest import DATA
from tidemark.llm import chat, components, hnsw, jaccard, langid, lengths, mixing, packing, planes, quality, queries, scratch, tokens, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "wörd " * 30_000
#: Nulls in any column, empty and blank texts, ties and repeated rows, one very long text.
ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t", None, "a", 3), (4, "one two", "en", None, 7), (None, "no id here at all", "en", "b", 17),
    (5, "the same words again and again here", "en", "b", 35), (5, "the same words again and again here", "en", "b", 35), (6, "the same words again and again here", None, "b", 35),
    (7, LONG, "de", "c", len(LONG)), (8, "<|endoftext|> ### x </turn> \\ ; 漢字 é", "fr", "c", 30), (9, "12 34 56", "fr", "c", 8),
]
LIBRARY = Tokenizer.from_file(tokens.vocabulary())


def encoded(text, *more):
    return np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids + list(more), "<u4")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def same_as_duck(spark, name):
    connection = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    frame, expected = queries.QUERIES[name](spark, DATA), connection.sql(queries.ORACLES[name])
    columns, places = sorted(frame.columns), sorted(expected.columns)
    assert columns == places
    order = [list(expected.columns).index(c) for c in columns]
    shown = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(shown(r[c]) for c in columns) for r in frame.collect()) == sorted(tuple(shown(r[p]) for p in order) for r in expected.fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    same_as_duck(spark, name)


# Encoding ------------------------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAéÉßÿŸ'st dm.,#<|>12İΣ́̈\xa0\x85\x1c漢字µª×÷-_\n\tendofx"), max_size=80))
def test_words_give_the_librarys_ids(text):
    assert tokens.encoder(tokens.vocabulary()).ids(text.encode()) == encoded(text).tobytes()


def test_vocabularies_that_keep_white_space_are_refused():
    import pathlib

    others = [p for p in pathlib.Path(tokens.vocabulary()).parent.glob("*.json") if p.name != tokens.WORD_BPE]
    for path in others:
        library = Tokenizer.from_file(str(path))
        spaced = library.encode("a b\n\nc", add_special_tokens=False).ids == [i for w in "abc" for i in library.encode(w, add_special_tokens=False).ids]
        if not spaced:
            with pytest.raises(ValueError, match="white space"):
                tokens.WordEncoder(str(path))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 6)), st.integers(-(1 << 63), (1 << 63) - 1)), max_size=60), st.integers(1, 9))
def test_ranges_keep_the_order(rows, parts):
    import pyarrow as pa

    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    there = sorted(r[0] for r in rows if r[0] is not None)
    bounds = np.array([there[len(there) * k // parts] for k in range(1, parts)] if there else [], np.int64)
    nulls = 2 if len(there) < len(rows) else 0
    found = planes._parts(pa.array([r[0] for r in rows], pa.int64()), np.array([r[1] for r in rows], np.int64), parts + nulls, nulls, bounds)
    assert (np.diff(found) >= 0).all() and all(0 <= f < parts + nulls for f in found) and all((f < nulls) == (r[0] is None) for f, r in zip(found, rows))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.none() | st.text("aA é.,!&\t\n\x0b\x1c\x85\xa0\u2003漢3ß", max_size=20), max_size=5), st.sampled_from(["<u2", "<u4"]))
def test_columns_give_the_librarys_ids(texts, width):
    import pyarrow as pa

    found = tokens.encoder(tokens.vocabulary()).column(pa.array([*texts, "x", ""], pa.string()).slice(0, len(texts)), width, encoded("", 2).tobytes())
    assert found.to_pylist() == [encoded(text, 2).astype(width).tobytes() for text in texts]


def test_forms_of_a_word_ask_the_model_once():
    import pyarrow as pa

    encoder, asked = tokens.WordEncoder(tokens.vocabulary()), []
    model = encoder._model
    encoder._model = lambda text: asked.append(text) or model(text)
    forms = "wort Wort wort, WORT. wort,"
    assert encoder.ids(forms.encode()) == encoded(forms).tobytes() and sorted(asked) == [",", ".", "wort"]
    small = tokens.WordEncoder(tokens.vocabulary(), memory_words=2, memory_bytes=5)
    texts = [forms, "ein Wort", None, "zwei Wörter, drei Wörter", forms]
    assert [small.column(pa.array([t], pa.string()), "<u4").to_pylist()[0] for t in texts] == [encoded(t).tobytes() for t in texts]


def test_forgetting_words_changes_nothing():
    small = tokens.WordEncoder(tokens.vocabulary(), memory_words=3, memory_bytes=6)
    text = "alpha beta gamma delta <|endoftext|> alpha extraordinarily beta"
    assert small.ids(text.encode()) == encoded(text).tobytes()


# Mixing --------------------------------------------------------------------------------------------------


def test_water_fill_is_the_rounds(spark):
    for sizes in ([10, 1000, 30, 5], [1, 1, 1, 100], [0, 7, 7], [3]):
        weights = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
        target, capped, total = dict(enumerate([0.0] * len(sizes))), set(), sum(sizes)
        while True:
            left, open_weight = total - sum(3 * sizes[k] for k in capped), sum(w for k, w in enumerate(weights) if k not in capped)
            target = {k: 3.0 * sizes[k] if k in capped else left * weights[k] / open_weight for k in target}
            over = {k for k in target if target[k] > 3 * sizes[k]} - capped
            if not over:
                break
            capped |= over
        rows = spark.createDataFrame([(k, s, weights[k]) for k, s in enumerate(sizes)], "_mix_rank int, source_size long, weight int")
        got = {r._mix_rank: r.target for r in mixing.water_fill(rows).collect()}
        assert got == pytest.approx(target) and sum(got.values()) == pytest.approx(total)


def test_mix(spark, docs, odd):
    rows = mixing.mix(docs).collect()
    taken = collections.Counter()
    for r in rows:
        assert r.taken == r.times * r["size"] <= 3 * r["size"]
        taken[r.source] += r.taken
    most = max(r["size"] for r in rows)
    assert all(abs(taken[r.source] - r.target) <= most / 2 for r in rows)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.times) for r in rows) == sorted((r.doc_id, r.times) for r in again)
    clash = odd.withColumnRenamed("n_chars", "size")
    assert mixing.mix(clash).count() == len(ODD) and mixing.mix(odd.limit(0)).count() == 0
    assert mixing.mixed_rows(odd).columns == odd.columns


# Packing, lengths, planes --------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=60))
def test_best_fit_and_bound(sizes):
    bins, offsets = packing.best_fit_decreasing(np.array(sizes), 20)
    fill = collections.defaultdict(list)
    for b, o, s in zip(bins, offsets, sizes):
        fill[b].append((o, s))
    for held in fill.values():
        at = 0
        for o, s in sorted(held):
            assert o == at
            at += s
        assert at <= 20
    assert -(-sum(sizes) // 20) <= packing.bin_bound(np.array(sizes), 20) <= len(fill)


def check_packed(rows, texts):
    want = collections.Counter()
    for doc_id, text in texts:
        ids = encoded(text, 1)
        want.update((doc_id, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for k in range(0, len(ids), 4096))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    return len(held)


def test_packing(spark, docs, odd):
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    whole = check_packed(packing.pack_documents(docs).collect(), texts)
    pieces = scratch.stage(packing.token_pieces(docs), "test")
    dealt = packing.pack(pieces, partition_rows=20).collect()
    assert {r["round"] for r in dealt} - {-1, 0} and whole <= check_packed(dealt, texts) <= whole + 3
    check_packed(packing.pack_documents(odd).collect(), [(r[0], r[1]) for r in ODD])
    assert packing.pack_documents(odd.limit(0)).count() == 0
    packed = packing.pack_documents(odd, keep_ids=True)
    rows = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert bytes(rows[r.sequence_id].ids)[4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)


def test_lengths(spark, docs, odd):
    histogram = scratch.stage(lengths.length_histogram(docs), "test")
    all_lengths = np.array(sorted(len(encoded(r.text)) for r in docs.collect()))
    for r in lengths.limit_table(histogram).collect():
        assert (r.docs_within, r.docs_longer, r.truncated_total) == ((all_lengths <= r.n_tokens).sum(), (all_lengths > r.n_tokens).sum(), np.minimum(all_lengths, r.n_tokens).sum())
    assert tuple(lengths.truncated_total(histogram, 500).first()) == (np.minimum(all_lengths, 500).sum(), (all_lengths > 500).sum())
    assert lengths.length_quantile(lengths.limit_table(histogram), 0.5).first()[0] == all_lengths[(len(all_lengths) - 1) // 2]
    assert lengths.length_histogram(odd).where("n_tokens = 0").first().n_docs == 3 and lengths.length_histogram(odd.limit(0)).count() == 0


@pytest.mark.parametrize("kind", [4, 32])
@pytest.mark.parametrize("block", [3, 8, 1000])
def test_shards(kind, block):
    given_ids = [(1, [5, 1 << 31, 7]), (None, []), (2, list(range(50)))]
    out = io.BytesIO()
    writer = planes.ShardWriter(out, kind, block)
    for doc_id, ids in given_ids:
        writer.add(doc_id, np.array(ids, "<u4").tobytes())
    assert writer.close() == 53
    reader = planes.ShardReader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    assert [(d, np.concatenate([*p, np.empty(0, "<u4")]).astype(int).tolist()) for d, _, p in reader.documents()] == given_ids
    assert reader.ids(4, 10).tolist() == list(range(1, 11))


def test_planes(spark, docs, odd):
    for frame, texts in ((docs, [(r.doc_id, r.text) for r in docs.collect()]), (odd, [(r[0], r[1]) for r in ODD])):
        folder = scratch.new_path(spark, "test-planes")
        rows = sorted(planes.read_shards(spark, folder, planes.write_shards(frame, folder)).collect(), key=lambda r: r.start)
        assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows]).tolist()[:-1]
        assert [r.doc_id for r in rows] == sorted((t[0] for t in texts), key=lambda d: (d is not None, d))
        assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == collections.Counter((d, len(e), zlib.crc32(e.tobytes())) for d, t in texts for e in [encoded(t, 2)])
    folder = scratch.new_path(spark, "test-planes")
    assert planes.read_shards(spark, folder, planes.write_shards(odd.limit(0), folder)).count() == 0


# Jaccard -------------------------------------------------------------------------------------------------


def brute_components(rows, ngram, percent):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + ngram]) for k in range(len(w) - ngram + 1)) if len(w) >= ngram else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            inside = len(sets[a] & sets[b])
            if inside and 100 * inside >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("ngram, percent, block", [(3, 90, 256), (5, 80, 2), (3, 50, 3)])
def test_components_are_brute_force(spark, docs, ngram, percent, block):
    rng = random.Random(ngram)
    base = [rng.choice("abcdefghij") + str(rng.randrange(9)) for _ in range(60)]
    made = []
    for k in range(60):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(60)] = f"x{k}"
        made.append((10_000 + k, " ".join(words)))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + made
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame, ngram, percent, block=block).collect()}
    assert got == brute_components(rows, ngram, percent)


def test_a_large_cell_of_near_but_unlinked_sets(spark):
    """All share the rarest shingles that they have in common, at 85 percent; some link in threes and some share prefix and size."""
    base = [f"w{k}" for k in range(48)]
    rows = [(k, " ".join(base + [f"u{k}x{j}" for j in range(4)])) for k in range(500)]
    rows += [(1000 + k, " ".join(base + [f"u{k // 3}y{j}" for j in range(3)] + [f"z{k}"])) for k in range(60)]
    rows += [(2000 + k, " ".join([f"v{k % 2}{j}" if j % 9 == 0 else w for j, w in enumerate(base)] + ["t", "t2", "t3"])) for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame, 3, 90, block=64).collect()}
    assert got == brute_components(rows, 3, 90) and len({c for _, c in got.values()}) > 500


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40)), min_size=1, max_size=4), st.lists(st.sets(st.integers(0, 40)), min_size=1, max_size=4))
def test_bits_of_groups_are_bounds(x, y):
    words = lambda sets: np.stack([np.frombuffer(jaccard.parities(np.array(sorted(s), np.uint64)), np.uint64) for s in sets])
    a, b = words(x), words(y)
    ones, ors = np.stack([np.bitwise_and.reduce(a), np.bitwise_and.reduce(b)]), np.stack([np.bitwise_or.reduce(a), np.bitwise_or.reduce(b)])
    assert jaccard.groups_apart(ones, ors, np.array([0]), np.array([1]))[0] <= min(len(s ^ t) for s in x for t in y)


def test_jaccard_odd_rows(spark, odd):
    rows = jaccard.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by_id = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert by_id[1] == (0, 1) and by_id[3] == (0, 3) and by_id[4] == (1, 4) and by_id[5] == by_id[6] == (5, 5) and by_id[None][1] is None and by_id[7] == (1, 7)
    assert jaccard.near_duplicates(odd.limit(0)).count() == 0
    kept = jaccard.deduplicated(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9]


def test_bounds_hold():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 9000).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, n)) for n in (10, 900, 1500, 5000, 8000)]
    bits = [jaccard.parities(s) for s in sets]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert jaccard.least_apart(bits, np.array([i]), np.array([j]))[0] <= len(np.setxor1d(a, b))


def test_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 99)], "a long, b long")
    assert {r.node: r.component for r in components.components(links).collect()} == {**{k: 0 for k in range(41)}, 99: 99, 100: 99}
    assert components.components(links.limit(0)).count() == 0


# Language, quality ---------------------------------------------------------------------------------------


def test_language(spark, docs, odd):
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    model = langid.learn(docs)
    found = {r.doc_id: r for r in langid.identified(odd, model).collect()}
    assert all(found[k].lang_pred == "und" and found[k].lang_score == 0 for k in (1, 2, 3, 9)) and found[8].lang_pred in model.languages
    assert langid.identify(odd.limit(0)).count() == 0
    assert langid.identified_documents(docs).columns == docs.columns


def test_unseen_scripts_count_for_no_language(spark, docs):
    frame = spark.createDataFrame([(0, "καλημέρα κόσμε " * 20, None, None, 0), (1, "hello there Здравствуй мир", None, None, 0)], DOCS)
    model = langid.learn(docs)
    found = {r.doc_id: r for r in langid.identified(frame, model).collect()}
    assert found[0].lang_score == 0 and found[0].lang_pred in model.languages and 0 < found[1].lang_score < 0.5


def test_labels_and_scores_are_brute_force(spark):
    """Two scripts, three languages: the narrowed candidates and the best path, against all paths of short texts."""
    import itertools

    rng = random.Random(4)
    words = {"aa": ["tok", "tak", "tik", "kot"], "bb": ["zum", "zam", "muz", "maz"], "ру": ["мир", "дом", "лес", "кот"]}
    taught = [(k, " ".join(rng.choices(words[lang], k=8)), lang, "s", 0) for k, lang in enumerate(sorted(words) * 30)]
    asked = [(1000 + k, " ".join(rng.choices(sum(words.values(), []), k=5)), None, "s", 0) for k in range(40)]
    model = langid.learn(spark.createDataFrame(taught, DOCS))
    assert model.languages == sorted(words) and model.scripts.sum() == 3
    found = {r.doc_id: r for r in langid.identified(spark.createDataFrame(asked, DOCS), model, spans=True).collect()}
    for doc_id, text, *_ in asked:
        held = langid.words_of(text.encode())
        scores = model.scores(held)[:, :-1]
        worth = lambda path: sum(scores[k, x] for k, x in enumerate(path)) - langid.PENALTY * sum(a != b for a, b in zip(path, path[1:]))  # noqa: B023, E731
        best = max(itertools.product(range(3), repeat=5), key=worth)
        own = [lang for s in found[doc_id].spans for lang in [s["lang"]] * (s["end"] - s["start"])]
        assert worth([model.languages.index(x) for x in own]) == pytest.approx(worth(best), abs=1e-3)
        assert all((lang == "ру") == (not w.isascii()) for lang, w in zip(own, held))
        letters = collections.Counter()
        for lang, w in zip(own, held):
            letters[lang] += len(w)
        assert letters[found[doc_id].lang_pred] == max(letters.values()) and found[doc_id].lang_score == pytest.approx(max(letters.values()) / sum(letters.values()))


def test_mixed_spans(spark, docs):
    model = langid.learn(docs)
    part = {r.lang: r.text for r in docs.where("length(text) > 400").orderBy("doc_id").collect()}
    mixed = spark.createDataFrame([(0, part["en"] + "\n" + part["de"], "x", "x", 0)], DOCS)
    row = langid.identified(mixed, model, spans=True).first()
    assert {"en", "de"} <= {s["lang"] for s in row.spans} and row.spans[0]["lang"] == "en" and row.spans[-1]["lang"] == "de" and row.n_spans == len(row.spans)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    lengths_ = np.array([5, 4, 4, 1])
    scores = rng.normal(size=(14, 3)).astype(np.float32)
    starts = np.cumsum(lengths_) - lengths_
    labels = langid.viterbi(scores, starts, lengths_, 0.7)
    import itertools

    for s, n in zip(starts, lengths_):
        worth = lambda p: sum(scores[s + k, x] for k, x in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        assert worth(labels[s : s + n]) == pytest.approx(max(map(worth, itertools.product(range(3), repeat=n))), abs=1e-4)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40))
def test_repeats(words):
    raw = [w.encode() for w in words]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    twice = {w for w, n in collections.Counter(windows).items() if n > 1}
    assert quality.repeated_words(raw) == len({k + j for k, w in enumerate(windows) if w in twice for j in range(5)})


def test_bad_hosts_and_odd_rows(spark, odd):
    good = [(k, " ".join(f"w{k}x{j}" for j in range(30)), "en", f"good{k % 6}", 0) for k in range(300)]
    bad = [(1000 + k, "too short" if k % 10 else good[0][1], "en", "bad", 0) for k in range(60)]
    few = [(2000, "short", "en", "few", 0), (2001, good[1][1], "en", "few", 0)]
    frame = spark.createDataFrame(good + bad + few, DOCS)
    kept = {r.doc_id for r in quality.verdicts(frame).collect() if r.kept}
    assert kept == {k for k in range(300)} | {2001} == {r.doc_id for r in quality.kept_documents(frame).collect()}
    assert quality.verdicts(odd).count() == len(ODD) and quality.verdicts(odd.limit(0)).count() == 0 and quality.kept_documents(odd).columns == odd.columns


# Columns that clash -------------------------------------------------------------------------------------

#: Names of helpers and outputs of all operators.
TAKEN = """size source_size target weight times taken _mix_order _mix_source _mix_s _mix_times _mix_copy _mix_mark _rejected_host _rejected host_rejected base_failed kept
    n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines _keep _again lang_pred lang_score n_spans spans held_out score n_shingles component_id
    component node label gid members common middle fold bits c1 c2 g1 g2 prefix cell centre part role row_id piece start length ids ids_crc32 bucket
    sequence_id offset loose round partition_bins partition_bound n_tokens n_docs text_hash path _carried_0 _carried_1 _digest _long _key _first refers_to
    shard dim vector rank query_id example final conv_n count""".split()
NEIGHBOURS = [(k, [float(k % 7 + 1), float(k % 5), 1.0]) for k in range(120)]
SAID = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, None, None), (None, 0, "assistant", "x")]


def archived(frame):
    folder = scratch.new_path(frame.sparkSession, "test-warc")
    warc.write_archives(frame, folder)
    return warc.page_captures(frame.sparkSession, folder)


def sharded(frame):
    folder = scratch.new_path(frame.sparkSession, "test-planes")
    return planes.read_shards(frame.sparkSession, folder, planes.write_shards(frame, folder))


@pytest.mark.parametrize("run", [
    mixing.mix, mixing.mixed_rows, quality.verdicts, quality.kept_documents, langid.identify, langid.identified_documents, jaccard.near_duplicates, jaccard.deduplicated,
    lambda f: packing.pack_documents(f).select("doc_id", "piece", "start", "length", "ids_crc32"), lengths.length_histogram, sharded, archived, hnsw.nearest,
    lambda f: chat.summarize(chat.expand(f)),
], ids="mix mixed_rows verdicts kept_documents identify identified_documents near_duplicates deduplicated packing lengths planes warc hnsw chat".split())
def test_clashing_columns_change_nothing(spark, odd, run, request):
    kind = request.node.callspec.id
    plain = {"warc": lambda: spark.createDataFrame(PAGES, "page_id long, url string, html string"), "hnsw": lambda: spark.createDataFrame(NEIGHBOURS, "vec_id long, embedding array<double>"),
             "chat": lambda: spark.createDataFrame(SAID, "conv_id long, turn long, role string, text string")}.get(kind, lambda: odd)()
    clashing = plain.select("*", *[F.lit(f"own {c}").alias(c) for c in TAKEN if c not in plain.columns])
    want, got = run(plain), run(clashing)
    assert set(want.columns) <= set(got.columns)
    rows = got.collect()
    assert sorted(str(tuple(r[c] for c in want.columns)) for r in rows) == sorted(map(str, map(tuple, want.collect())))
    if got.columns == clashing.columns:
        assert all(r[c] == f"own {c}" for r in rows for c in TAKEN)


def test_ids_that_are_no_whole_numbers_are_refused(spark, odd):
    texts = odd.withColumn("doc_id", F.col("doc_id").cast("string"))
    for run in (jaccard.near_duplicates, lambda f: planes.write_shards(f, scratch.new_path(spark, "test-planes"))):
        with pytest.raises(TypeError, match="doc_id"):
            run(texts)


def test_staged_tables_are_removed(spark):
    from pathlib import Path

    held, other = scratch.stage(spark.range(3), "test"), scratch.stage(spark.range(3), "test")
    places = [Path(f._tidemark_path.removeprefix("file://")) for f in (held, other)]
    assert all(p.is_dir() for p in places)
    scratch.release(held)
    assert [p.exists() for p in places] == [False, True] and other.count() == 3


def test_a_cluster_without_a_shared_folder_is_refused():
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda name, other=None: other)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_folder(Session)


def test_broadcasts_are_bounded_by_bytes(spark):
    rows = scratch.stage(spark.range(100).select("id", F.lit("x" * 5000).alias("held")), "test")
    hinted = lambda f: "Broadcast" in f._jdf.queryExecution().analyzed().toString() or "broadcast" in f._jdf.queryExecution().analyzed().toString()
    assert hinted(scratch.small_side(rows, 1000)) and not hinted(scratch.small_side(rows, 1000, 100_000)) and not hinted(scratch.small_side(rows, 99))


# Archives ------------------------------------------------------------------------------------------------

PAGES = [(1, "http://a/1", "x" * 200), (2, "http://a/2", "x" * 200), (3, None, None), (4, "u\r\nv", "é" * 60), (5, "http://a/5", ""), (None, "n", "x" * 200), (6, "s", "s"), (6, "s", "s")]


@pytest.mark.parametrize("compressed", [True, False])
def test_archives(spark, compressed):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder = scratch.new_path(spark, "test-warc")
    warc.write_archives(pages, folder, compressed)
    rows = {r.page_id: r for r in warc.page_captures(spark, folder).collect()}
    assert (rows[1].record_type, rows[2].record_type, rows[2].refers_to, rows[2].payload_bytes, rows[None].refers_to) == ("response", "revisit", 1, 200, 1)
    assert rows[3].payload_bytes == rows[5].payload_bytes == 0 and rows[4].payload_bytes == 120 and rows[4].record_type == "response"
    frame = warc.read_archives(spark, folder).where("record_type = 'response' and content_length > 200 and target_uri like 'http://a%'")
    assert "PushedFilters: [" in frame._jdf.queryExecution().toString() or frame.count() == 1
    assert [r.target_uri for r in frame.collect()] == ["http://a/1"]
    empty = scratch.new_path(spark, "test-warc")
    warc.write_archives(pages.limit(0), empty)
    assert warc.page_captures(spark, empty).count() == 0


def test_files_of_lost_attempts_are_not_read_and_large_archives_are_split(spark, monkeypatch):
    monkeypatch.setattr(warc, "PARTITION_BYTES", 600)
    from pathlib import Path

    pages = spark.createDataFrame([(k, f"http://a/{k}", f"{k} " * 300) for k in range(40)], "page_id long, url string, html string").coalesce(1)
    folder = scratch.new_path(spark, "test-warc")
    stretches = warc.write_archives(pages, folder, compressed=False).collect()
    place = Path(folder.removeprefix("file://"))
    whole = next(place.glob("*.warc"))
    (place / "pages-000000-lost.warc").write_bytes(whole.read_bytes()[:5000])
    assert sum(r.records for r in stretches) == 40 and sum(r.bytes for r in stretches) == whole.stat().st_size
    frame = warc.read_archives(spark, folder, partitionBytes=2000)
    assert frame.rdd.getNumPartitions() > 5 and sorted(r.record_id for r in frame.collect()) == sorted(f"<urn:page:{k}>" for k in range(40))


def test_shards_of_lost_attempts_are_not_read(spark, docs):
    from pathlib import Path

    folder = scratch.new_path(spark, "test-planes")
    manifest = planes.write_shards(docs, folder)
    place = Path(folder.removeprefix("file://"))
    (place / "shard-000000-lost.planes").write_bytes(next(place.glob("*.planes")).read_bytes()[:100])
    assert planes.read_shards(spark, folder, manifest).count() == docs.count()


def test_other_writers_and_payloads_left_alone():
    records = [warc.record(bytes([65 + k]) * 5000, "d", f"u{k}", k) for k in range(3)]
    for data in (b"".join(map(gzip.compress, records)), b"".join(map(warc.gzip_member, records)), b"".join(records)):
        seen = []
        rows = list(warc.read_records(io.BytesIO(data), lambda r: (seen.append(r["payload"]), r["target_uri"] == "u1")[1]))
        assert seen == [None] * 3 and [r["payload"] for r in rows] == [b"B" * 5000]
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(warc.gzip_member(records[0])[:60])))


# Neighbours, chat, pipeline ------------------------------------------------------------------------------


def test_recall_and_ties(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(1500, 16))
    vectors[700:760] = vectors[0]
    rows = [(int(k), v.tolist()) for k, v in enumerate(vectors)] + [(5000, None), (5050, []), (5100, [0.0] * 16), (5150, [float("nan")] * 16), (5200, [None] * 16), (50, vectors[50].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in sorted(hnsw.nearest(frame, shard_rows=400).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append(r.vec_id)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 50):
        near = np.round(unit @ unit[q], 12)
        near[q] = -9
        hits += len(set(got[q]) & set(np.lexsort((np.arange(1500), -near))[:5].tolist()))
    assert set(got) == set(range(0, 1500, 50)) and hits >= 0.9 * 5 * 30
    assert got[0] == [700, 701, 702, 703, 704] and got[700] == [0, 701, 702, 703, 704]
    assert hnsw.nearest(frame.limit(0)).count() == 0


@pytest.mark.parametrize("clusters, rows", [(20, 100), (16, 128), (8, 256), (4, 500), (2, 2000)])
@pytest.mark.parametrize("apart", [0.2, 0.001])
def test_recall_on_clusters_of_near_copies(clusters, rows, apart):
    rng = np.random.default_rng(clusters)
    vectors = np.repeat(rng.normal(size=(clusters, 64)), rows, axis=0) + apart * rng.normal(size=(clusters * rows, 64))
    asked = np.arange(0, len(vectors), 25)
    unit = hnsw._unit(vectors)
    found = hnsw.Graph.of(hnsw.Graph.build(vectors).flat()).search(unit, unit[asked])
    near = unit[asked] @ unit.T
    near[np.arange(len(asked)), asked] = -9
    hits = sum(len(set(f[f != a][:5].tolist()) & set(best.tolist())) for a, f, best in zip(asked, found, np.argsort(-near, axis=1)[:, :5]))
    assert hits >= 0.9 * 5 * len(asked)


@pytest.mark.parametrize("spread", [0.4, 5.0])
def test_recall_and_scores_with_few_of_many_shards(spark, spread):
    rng = np.random.default_rng(8)
    vectors = np.repeat(rng.normal(size=(30, 24)), 130, axis=0) + spread * rng.normal(size=(3900, 24))
    vectors[2000:2600] = vectors[2000]  # a region of more rows than a shard holds
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, vector array<double>")
    index = hnsw.build_index(frame, 5, 100)
    shards = index.shards.count()
    assert shards == index.regions.agg(F.sum("shards")).first()[0] >= 39 and index.regions.count() > 25
    asked = frame.where("vec_id % 50 = 0")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for probes, least in ((12, 0.9), (None, 0.97)):
        hits, rows = 0, hnsw.search_index(index, asked, probes=probes).collect()
        for q in range(0, 3900, 50):
            near = np.round(unit @ unit[q], 12)
            near[q] = -9
            hits += len({r.vec_id for r in rows if r.query_id == q} & set(np.lexsort((np.arange(3900), -near))[:5].tolist()))
        assert hits >= least * 5 * 78 and len(rows) == 5 * 78
        for r in rows:
            x, y = vectors[r.query_id], vectors[r.vec_id]
            assert r.score == pytest.approx(float(x @ y / np.sqrt((x @ x) * (y @ y))), abs=1e-14)
    routed = hnsw._placed(asked, index.centres, 12)
    assert routed.count() == 12 * 78


def test_every_node_is_reached_from_the_level_above():
    links = np.array([[1, -1], [0, -1], [3, -1], [2, -1], [0, 2]])
    assert np.nonzero(hnsw._entries(links, np.array([True, False, False, False, False])))[0].tolist() == [0, 2, 4]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("a:# </turn>\\\n", max_size=12), st.text("#/ <turn>\\:A\n", max_size=30)), max_size=4))
def test_chat_round_trip(turns):
    text = "".join(f"{chat.TURN}{chat.escape(r).replace(chat.COLON, chr(92) + chat.COLON)}{chat.COLON}{chat.escape(t)}{chat.END}\n" for r, t in turns)
    assert list(chat.parse(text)) == turns


def test_examples(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", None), (1, 3, "assistant", "no </turn>"), (2, None, None, "x"), (None, 1, "assistant", ""), (3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    examples = chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = [(r.conv_id, r.example, chat.unescape(r.text[r.loss_start : r.loss_end]), r.final, len(list(chat.parse(r.text)))) for r in examples.collect()]
    assert sorted(got, key=str) == sorted([(1, 0, "yes", False, 2), (1, 1, "no </turn>", True, 4), (2, 0, "", True, 1), (None, 0, "", True, 1), (3, 0, "same", False, 1), (3, 1, "same", True, 2)], key=str)
    assert chat.summarize(examples.limit(0)).count() == 0


def test_long_conversations_are_staged_in_small_pieces(spark, tmp_path):
    import pathlib

    import pyarrow.parquet as pq

    rows = [(c, k, ("user", "assistant")[k % 2], f"{k} \\ </turn> " + "wörd " * 60) for c, n in ((1, 600), (2, 3), (None, 1), (3, 0)) for k in range(n)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    shared = pathlib.Path(scratch.shared_folder(spark).removeprefix("file:"))
    before = set(shared.glob("tidemark-*"))
    got = {r.conv_id: r for r in queries.op10_prefix_targets(spark, str(tmp_path)).collect()}
    staged = [p for folder in set(shared.glob("tidemark-*")) - before for p in folder.rglob("*.parquet")]
    groups = [m.row_group(k).total_byte_size for p in staged for m in [pq.read_metadata(p)] for k in range(m.num_row_groups)]
    longest = max(len(r.text.encode()) for r in chat.expand(turns).collect())
    assert len(groups) > 5 and max(groups) <= 2 * chat.BATCH_CHARS + longest
    expected = {r.conv_id: r for r in chat.summarize(chat.expand(turns)).collect()}
    assert set(expected) == {1, 2, None} and got == expected | {-7: got[-7]} and got[1].n_examples == 300


def test_examples_of_lost_attempts_are_not_read(spark):
    import pathlib

    turns = spark.createDataFrame(SAID, "conv_id long, turn long, role string, text string")
    folder = scratch.new_path(spark, "test-chat")
    manifest = chat.write_examples(turns, folder)
    place = pathlib.Path(folder.removeprefix("file:"))
    (place / "examples-000000-lost.parquet").write_bytes(next(place.glob("*.parquet")).read_bytes()[:100])
    assert set(chat.read_summaries(spark, folder, manifest).collect()) == set(chat.summarize(chat.expand(turns)).collect())
    folder = scratch.new_path(spark, "test-chat")
    assert chat.read_summaries(spark, folder, chat.write_examples(turns.limit(0), folder)).count() == 0


def test_pipeline(spark, docs):
    frame, before = docs, docs.count()
    for name, function in corpus_pipeline.STAGES[:-1]:
        source = frame
        frame = scratch.stage(function(spark, frame, DATA), "test-stage")
        assert frame.columns == docs.columns, name
        if name == "quality rules":
            assert {r.doc_id for r in frame.collect()} == {r.doc_id for r in quality.verdicts(source).collect() if r.kept}
        if name == "n-gram Jaccard join":
            own = brute_components([(r.doc_id, r.text) for r in source.collect()], 5, 80)
            assert {r.doc_id for r in frame.collect()} == {i for i, (_, c) in own.items() if i == c}
        if name == "mixing sources":
            assert collections.Counter(r.doc_id for r in frame.collect()) == collections.Counter({r.doc_id: r.times for r in mixing.mix(source).collect() if r.times})
    assert before > 100
    check_packed(corpus_pipeline.STAGES[-1][1](spark, frame, DATA).collect(), [(r.doc_id, r.text) for r in frame.collect()])


def test_a_worker_remembers_for_one_operator():
    from tidemark.llm.remembered import forget, remembered

    forget()
    first = remembered("a", dict)
    assert remembered("a", dict) is first
    remembered("b", dict)
    assert remembered("a", dict) is not first
    forget()


def test_short_batches_only_lower_limits(spark):
    from tidemark.llm.scratch import SHORT, short_batches

    name = "spark.sql.parquet.columnarReaderBatchSize"
    short_batches(spark)
    assert all(0 < int(spark.conf.get(n)) <= most for n, most in SHORT.items())
    spark.conf.set(name, 64)
    assert short_batches(spark).conf.get(name) == "64"
    spark.conf.unset(name)
