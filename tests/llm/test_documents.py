"""Operators over documents against plain versions, and over nulls, empty and long texts, ties, copies and no rows."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from riskspark.llm import compression, mixing, neardup, pieces, quality_fm, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, score string, kept string, id string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def _rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(6)]
    near = [" ".join("zz" if i == 60 + j else w for i, w in enumerate(base[0].split())) for j in range(5)]
    odd = [
        None, "", " \n\t ", "one", "two words", "a b c d e f a b c d e\n\na\n a\na\r\na", "é\x85x ü\n\n\n x", "<|endoftext|> I'll 3.5's ￼", "▁a  b́",
        "x" * 5000, "la " * 3000, "Same Line\nsame line\nSame Line", base[1].upper(), base[0], base[0], "###&&& $$$ |||" * 30,
    ]
    texts = base + near + odd
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "x", "y", "z", "w") for i, t in enumerate(texts)]
    rows += [(None, base[2], None, None, None, None, None, None, None), (3, base[3], "en", "s0", 5, "x", "y", "z", "w"), (50, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3)


def test_compression_counts_and_verdict(docs):
    got = compression.compression_rules(docs, keep=["doc_id", "text"]).collect()
    assert len(got) == len(_rows())
    for r in got:
        text = r.text or ""
        words = WORD.findall(text)
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
        lines = [line for line in text.split("\n") if WORD.search(line)]
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert (r.n_symbols, r.n_dup_lines) == (len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)))
        assert r.n_repeat_words == len(covered)
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        assert not (r.base_failed and r.kept)


def test_compression_bands_reject_extremes(spark):
    rng = random.Random(1)
    noise = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/!?=@", k=40)) for _ in range(400))
    few = " ".join(rng.choices(["aaaa", "bbbb"], k=20000))
    prose = " ".join(rng.choices([f"word{i}" for i in range(3000)], k=2000))
    got = compression.compression_rules(spark.createDataFrame([(1, noise), (2, few), (3, prose)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.kept for r in got} == {1: False, 2: False, 3: True}


def test_compression_finds_bad_passages_of_any_place(spark):
    rng = random.Random(2)
    prose = " ".join(rng.choices([f"{a}{b}{c}" for a in ("re", "con", "un") for b in ("ta", "li", "mo") for c in ("ing", "ed", "s", "ly")], k=8000))
    words = prose.encode()
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/!?=@#"
    noise = lambda n: "".join(rng.choices(letters, k=n))
    text = lambda start, n: words[start : start + n].decode()
    prose_of = [text(0, n) for n in (600, 1500, 4095, 4096, 8190, 30000)]
    bad = []
    for middle in (noise, lambda n: "a" * n):
        bad += [text(0, 4096) + middle(4094), text(0, 1200) + middle(1000), text(0, 700) + middle(1600) + text(700, 700)]
        bad += [text(0, 20000 + i) + middle(2100) + text(20000, 16000) for i in (0, 100, 255, 300, 511)]
    rows = [(i, t) for i, t in enumerate(prose_of + bad)]
    got = {r.doc_id: r for r in compression.compression_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    base_ok = {i for i, r in got.items() if not r.base_failed}
    assert base_ok >= set(range(len(prose_of))) | {len(prose_of)}
    assert {i for i in base_ok if got[i].kept} == set(range(len(prose_of)))
    # letters in one word do not fail the base rule, so the verdict is that of the ratios
    assert len(base_ok) > len(prose_of) + 4
    assert all(got[i].n_bad_bytes == got[i].bad_run == 0 for i in range(len(prose_of)))


def test_token_counts_use_the_cache(docs, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    cache = f"file://{tmp_path}/cache"
    first = tokens.token_counts(docs.drop("n_tokens"), path, cache).collect()
    assert len(first) == len(_rows())
    for r in first:
        assert r.n_tokens == len(whole.encode(r.text or "", add_special_tokens=False).ids)
    stored = docs.sparkSession.read.parquet(cache).count()
    assert stored == len({tokens_key(r.text) for r in first})
    again = tokens.token_counts(docs, path, cache, keep=["doc_id"]).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in again) == sorted((r.doc_id or -1, r.n_tokens) for r in first)
    assert docs.sparkSession.read.parquet(cache).count() == stored


def tokens_key(text):
    return " ".join((text or "").encode().split(None)[i].decode() for i in range(len((text or "").encode().split())))


def test_tokens_of_another_tokenizer_are_counted_whole(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    for r in tokens.token_counts(docs, path, keep=["text"]).collect():
        assert r.n_tokens == len(whole.encode(r.text or "", add_special_tokens=False).ids)


def test_pieces_equal_the_library(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = pieces.encode_documents(docs, path).collect()
    assert len(got) == len(_rows())
    for r in got:
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded == library.decode(ids) and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_pieces_of_random_strings():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, codec, rng = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceCodec(path), random.Random(9)
    texts = ["".join(rng.choices("abehlnost  ▁<>/é日😀.,\n", k=rng.randint(1, 200))) for _ in range(400)]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == library.encode(texts, add_bos=True, add_eos=True)


def _components(rows, k, num, den):
    sets, names = [], []
    for doc_id, text in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())
        sets.append(grams)
        names.append(doc_id)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, name in enumerate(names):
        if name is not None:
            least[find(i)] = min(name, least.get(find(i), name))
    return sorted((n if n is not None else -1, len(s), -1 if least.get(find(i)) is None else least[find(i)]) for i, (n, s) in enumerate(zip(names, sets, strict=True)))


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 8, 10)])
def test_near_duplicates_equal_all_pairs(spark, k, num, den):
    rng = random.Random(k)
    words = [f"w{i}" for i in range(300)]
    passage = rng.choices(words, k=60)
    rows = [(r[0], r[1]) for r in _rows()]
    hub = rng.choices(words, k=150)
    for i in range(120):  # a group of near copies, many of which do not link, and one passage in many texts
        copy = list(hub)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(150)] = rng.choice(words)
        rows.append((1000 + i, " ".join(copy)))
        rows.append((3000 - i, " ".join(passage + rng.choices(words, k=rng.randint(1, 60)))))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = neardup.near_duplicates(frame, k, num, den).collect()
    assert sorted(((-1 if r.id is None else r.id), r.n_shingles, (-1 if r.component_id is None else r.component_id)) for r in got) == _components(rows, k, num, den)


def test_near_duplicates_of_groups_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HUB_ROUNDS", 0)  # every link is left to the parts of groups
    monkeypatch.setattr(neardup, "PART_BYTES", 1000)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    hub = rng.choices(words, k=150)
    rows = []
    for i in range(60):
        copy = list(hub)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(150)] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.id, r.n_shingles, r.component_id) for r in got) == _components(rows, 3, 90, 100)


def test_large_groups_hand_few_pairs_to_the_join_on_sketches(spark, monkeypatch):
    """Copies of one text, any two a little less alike than asked for: their pairs grow with the square of the group."""
    met, verify = [], neardup._verify

    def seen(pairs, *rest):
        met.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(neardup, "_verify", seen)
    monkeypatch.setattr(neardup, "HUB_ROUNDS", 0)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    base = rng.choices(words, k=400)
    rows = []
    for i in range(120):
        copy = list(base)
        for at in rng.sample(range(0, 400, 5), 6):
            copy[at] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 5, 8, 10).collect()
    assert sorted((r.id, r.n_shingles, r.component_id) for r in got) == _components(rows, 5, 8, 10)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(396)} for _, t in rows]
    links = sum(10 * len(x & y) >= 8 * len(x | y) for i, x in enumerate(sets) for y in sets[:i])
    assert sum(met) <= links + 1800  # of 7,140 pairs; copies changed at the same place also meet in small groups, by brief sketches


def test_near_duplicates_group_keys_without_windows(docs, monkeypatch):
    plans, stored = [], neardup._stored

    def seen(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df, name)

    monkeypatch.setattr(neardup, "_stored", seen)
    neardup.near_duplicates(docs).count()
    assert plans and not [p for p in plans if "Window" in p]


def test_pipeline_keeps_one_row_of_each_component(spark):
    import corpus_pipeline

    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    one, two, three = (" ".join(rng.choices(words, k=120)) for _ in range(3))
    near = lambda text: text + " z"
    rows = [
        (7, one), (None, near(one)), (None, two), (None, near(two)), (5, three), (3, near(three)), (5, one + " y"),
        (5, three), (None, None), (None, None), (None, ""), (9, " "), (9, " "),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
    of_two = [r for r in kept if r in ((None, two), (None, near(two)))]
    assert len(of_two) == 1
    assert kept == sorted([(5, one + " y"), (3, near(three)), *of_two, (None, None), (None, None), (None, ""), (9, " "), (9, " ")], key=repr)


def test_folded_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    for size in (1, 64, 65, 700, 1000):
        a, b = (np.unique(rng.integers(0, 2 * size, n).astype(np.uint64)) for n in (size, size * 3 // 2 + 1))
        one, two = neardup.folded([np.frombuffer(neardup.own_sketch(m), np.uint64) for m in (a, b)])
        assert int(np.bitwise_count(one ^ two).sum()) <= len(np.setxor1d(a, b))


def test_parity_sketch_bounds_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 300, 200).astype(np.uint64)) for _ in range(2))
        distance = int(np.bitwise_count(neardup.parity_sketch(a) ^ neardup.parity_sketch(b)).sum())
        assert distance <= len(np.setxor1d(a, b))


def test_quality_classifier_learns_and_leaves_held_out_labels_alone(spark):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(600):
        text = rng.choices(words, k=rng.randint(30, 80))
        bad = i % 4 == 0
        rows.append((i, " ".join(w + "###" if bad else w for w in text), "en", "s", 100))
        labels.append((i, int(not bad)))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([*rows, (None, None, None, None, None), (9000, "", "en", "s", 0)], schema)
    labelled = spark.createDataFrame([*labels, (None, 1), (7, None), (3, 1)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality_fm.quality_scores(docs, labelled, keep=["doc_id"]).collect()}
    assert len(got) == 602 and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= 0.7) == bool(y) for i, y in labels)
    one = {r.score for r in quality_fm.quality_scores(docs, labelled.where("quality = 1"), keep=["doc_id"]).collect()}
    assert len(one) == 1


def test_factorisation_pairs_equal_the_double_sum():
    rng = np.random.default_rng(1)
    factors, owner = rng.normal(size=(40, 3)), np.array([0, 0, 0, 1, 1])
    index, value = np.array([3, 7, 9, 1, 30]), rng.normal(size=5)
    pairs = quality_fm._pair_sums(factors, owner, index, value)[1]
    for t in (0, 1):
        at = np.flatnonzero(owner == t)
        brute = sum(factors[index[i]] @ factors[index[j]] * value[i] * value[j] for i in at for j in at if i < j)
        assert abs(pairs[t] - brute) < 1e-9


def test_mixing_meets_its_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.randint(1, 40))), "big" if i % 10 < 6 else f"s{i % 10}") for i in range(2000)]
    docs = spark.createDataFrame([*rows, (5000, None, None), (5001, "", "big")], "doc_id long, text string, source string")
    got = mixing.temperature_mix(docs, mixing.Target(0.97, 4.0, 1.0), block_docs=50).collect()
    weights = {r["__source"]: r["__weight"] for r in got if r["__weight"] is not None}
    entropy = -sum(w * np.log(w) for w in weights.values()) / np.log(len(weights))
    assert abs(sum(weights.values()) - 1) < 1e-9 and 0.97 <= entropy < 0.9701
    total = sum(len(r[1].split()) for r in rows)
    for source, weight in weights.items():
        drawn = [r for r in got if r["__source"] == source]
        assert abs(sum(r["__tokens"] for r in drawn) - weight * total) <= 40
        epochs = {}
        for r in drawn:
            epochs.setdefault(r["__epoch"], []).append(r.doc_id)
        assert all(len(set(ids)) == len(ids) for ids in epochs.values())
    assert [r["__epoch"] for r in got if r.doc_id in (5000, 5001)] == [0, 0]
    limited = mixing.source_weights(docs.select("source", mixing.word_tokens(docs.text).alias("n_tokens")), mixing.Target(1.0, 1.2, 1.0)).collect()
    assert max(r.yield_tokens / r.n_tokens for r in limited if r.weight) <= 1.2 + 1e-6
    whole = mixing.temperature_mix(docs, mixing.Target(0.97, 2.0, None)).collect()
    assert {r.doc_id for r in whole} == {r[0] for r in rows} | {5000, 5001}


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    path, model = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
    assert compression.compression_rules(empty).count() == 0
    assert tokens.token_counts(empty, path).count() == 0
    assert pieces.encode_documents(empty, model).count() == 0
    assert neardup.near_duplicates(empty).count() == 0
    assert quality_fm.quality_scores(empty, labels).count() == 0
    assert mixing.temperature_mix(empty).count() == 0
