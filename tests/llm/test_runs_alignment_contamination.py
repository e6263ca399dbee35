"""Runs, alignment and decontamination against plain versions, over odd texts, clashing names and empty tables."""

import hashlib
import random
import re
from collections import Counter
from zlib import crc32

import public_tokenizers
import pytest
from riskspark.llm import alignment, contamination, queries, runs

SCHEMA = "doc_id long, text string, n_runs string, text_ string, key string, n_words long, spans string, at string"
PATHS = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def _texts():
    rng = random.Random(11)
    words = [f"W{i}" for i in range(60)] + ["a", "a,b", "é", "日本", "x-y"]
    prose = [" ".join(rng.choices(words, k=k)) for k in (1, 9, 10, 40, 400)]
    odd = [
        None, "", " \n\t ", "one", "la " * 900, "x y " * 40 + "z " + "x y " * 40, "a\x0bb\x1cc\x85d e", "<|endoftext|> </s> <0x41> ▁x", "é日本 😀́ " * 40,
        "q" * 3000, "\x00\x01 a", prose[4] + "\n" + prose[3], prose[3], prose[3].upper(), "pre. " + prose[3] + " ?! post", "\n".join([prose[2]] * 30),
    ]
    return prose + odd


@pytest.fixture(scope="module")
def rows():
    found = [(i, t, "x", "y", "z", 5, "s", "t") for i, t in enumerate(_texts() * 3)]
    return found + [(None, _texts()[4], None, None, None, None, None, None), (3, _texts()[3], "x", "y", "z", 5, "s", "t"), (3, _texts()[3], "x", "y", "z", 5, "s", "t")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def _plain_runs(words, least=24, times=3):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_a_plain_search():
    rng = random.Random(5)
    for least, times in ((24, 3), (9, 2), (2, 2), (3, 3), (40, 4)):
        for _ in range(150):
            texts = []
            for _ in range(rng.randint(1, 4)):
                words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(rng.choice([0, 1, 7, 60, 140]))]
                if words and rng.random() < 0.6:
                    a = rng.randrange(len(words))
                    p = 1 + (len(words) - a) // (2 + rng.randrange(6))
                    words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
                texts.append(words)
            assert runs.runs_of(texts, least, times) == [_plain_runs(w, least, times) for w in texts]
    with pytest.raises(ValueError):
        runs.runs_of([], 10, 1)


def _plain_row(words):
    found = _plain_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    start, length, period = best or (None, None, None)
    rest = b" ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return len(found), start, length, period, best and 1000 * length // period, digest(listed.encode()), digest(rest)


def test_runs_of_documents(docs, rows):
    got = runs.periodic_runs(docs, keep=["doc_id", "text", "text_", "n_runs"]).collect()
    assert len(got) == len(rows) and "n_runs" in got[0] and got[0].text_ in ("y", None)
    for r in got:
        words = (r.text or "").encode().split()
        assert tuple(r[c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) == _plain_row(words)
        assert [tuple(x) for x in r.runs] == _plain_runs(words)
        assert hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256
    assert runs.periodic_runs(docs.limit(0)).collect() == []


def test_runs_query(docs, rows):
    planted = {r.doc_id: r.text for r in queries.with_planted_periods(docs).where("doc_id is not null").collect()}
    changed = 0
    for doc_id, text, *_ in rows:
        if doc_id is None:
            continue
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        h, n = crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            changed += 1
        assert planted[doc_id] is None if text is None else planted[doc_id].encode().split() == " ".join(words).encode().split()
    assert changed


def _plain_alignment(pair, text):
    """Groups, links and their id pairs of one text, from the two sets of ends."""
    if not text:
        return None
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    ends = []
    for ids, spelled in ((a, pair.spelled_a), (b, pair.spelled_b)):
        if b"".join(spelled[i] for i in ids) != b" " + text.encode():
            return None
        total, found = 0, {}
        for place, i in enumerate(ids):
            total += len(spelled[i])
            found[total] = place
        ends.append(found)
    common, groups, links, x, y = sorted(set(ends[0]) & set(ends[1])), [], [], 0, 0
    for end in common:
        i, j = ends[0][end], ends[1][end]
        groups.append(",".join(map(str, a[x : i + 1])) + "|" + ",".join(map(str, b[y : j + 1])))
        links.append((a[i], b[j]))
        x, y = i + 1, j + 1
    return a, b, groups, links, common


@pytest.mark.parametrize("lane", [1024, 7])
def test_alignment_equals_a_plain_merge(docs, rows, monkeypatch, lane):
    if lane == 7:  # the same on the driver, where lanes and memory can be made short
        monkeypatch.setattr(alignment, "LANE_BYTES", lane)
        monkeypatch.setattr(alignment, "REMEMBERED_WORDS", 3)
        pair = alignment.Pair(*PATHS)
        pair.encode(["fills the memory", "before the texts come"])
        texts = [r[1] for r in rows] + ["x  y", " x y", "x y ", "a\n b c \td", "a\xa0 b\u3000c d", "it 's o 'll", "1 2 ,3 , 4", "é ́x"]
        found = alignment.Aligned(pair, texts)
        for text, groups, begin, end in zip(texts, found.groups(pair), found.at_link[:-1], found.at_link[1:], strict=True):
            plain = _plain_alignment(pair, text)
            assert groups == (";".join(plain[2]) if plain else "")
            assert end - begin == (len(plain[3]) if plain else 0)
        return
    pair = alignment.Pair(*PATHS)
    plain = {r[1]: _plain_alignment(pair, r[1]) for r in rows}
    counts = Counter(link for r in rows if plain[r[1]] for link in plain[r[1]][3])
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    got = alignment.align(docs.withColumn("n_a", docs.key).withColumn("numbers_", docs.key), *PATHS, keep=["doc_id", "text", "text_", "numbers_", "n_a"]).collect()
    assert len(got) == len(rows)
    for r in got:
        a, b, groups, links, common = plain[r.text] or ([], [], [], [], [])
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (len(a), len(b), len(groups), len(links))
        assert r.groups_sha256 == (hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        assert (r.a_ids, r.b_ids, r.cuts) == (a, b, common)
        assert [(r.a_ids[x], r.b_ids[y]) for x, y in zip(r.link_a, r.link_b, strict=True)] == links
        assert r.n_best == sum(counts[x] == highest[x[1]] for x in links)
        assert r.count_sum == sum(counts[x] for x in links)
    assert any(plain[t] is None for t in plain if t)  # a text that B spells otherwise
    assert alignment.align(docs.limit(0), *PATHS).collect() == []


_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _plain_hits(text, items, size):
    words = _WORD.findall((text or "").translate(_LOWER))
    hit, found = set(), set()
    for item, body in items:
        own = _WORD.findall((body or "").translate(_LOWER))
        width = min(size, len(own))
        for k in range(len(own) - width + 1 if width else 0):
            for i in range(len(words) - width + 1):
                if words[i : i + width] == own[k : k + width]:
                    hit.update(range(i, i + width))
                    found.add(item)
    return words, hit, sorted(str(i) for i in found if i is not None)


@pytest.fixture(scope="module")
def items():
    base = _texts()[3]
    words = base.split()
    return [
        (1, " ".join(words[:30])), (10, base.lower()), (2, None), (3, ""), (4, "!?"), (5, "pre"), (6, "X Y, x"), (6, "post"), (None, "日本"), (7, base), (7, base),
        (8, "never seen words of this benchmark that no text of the table holds at all"),
    ]


@pytest.mark.parametrize("limit", [32 << 20, 4000])
def test_hits_equal_a_plain_search(spark, docs, rows, items, monkeypatch, limit):
    monkeypatch.setattr(contamination, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(contamination, "COPIES", 1)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = contamination.benchmark_hits(docs, table, keep=["doc_id", "text", "key", "at", "n_words"]).collect()
    assert len(got) == len(rows) and {r.key for r in got} == {"z", None}
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows)
    for r in got:
        words, hit, found = _plain_hits(r.text, items, 10)
        assert (r.n_words, r.n_hit, r.n_items, r.items) == (len(words), len(hit), len(found), found)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest() and r.contaminated == bool(hit)
        assert {i for s in r.spans for i in range(s.start, s.start + s.length)} == hit
        assert all(a.start + a.length < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
    assert any(r.n_items > 2 for r in got)


@pytest.mark.parametrize("remove", ["documents", "spans"])
def test_removal(spark, docs, rows, items, remove):
    table = spark.createDataFrame(items, "item_id long, text string")
    got = contamination.decontaminate(docs, table, remove)
    assert got.columns == docs.columns
    expected = []
    for row in rows:
        _, hit, _ = _plain_hits(row[1], items, 10)
        if hit and remove == "spans":
            parts, last = [], 0
            for i, m in enumerate(_WORD.finditer(row[1].translate(_LOWER))):
                parts += [] if i in hit else [row[1][last : m.end()]]
                last = m.end()
            expected.append((row[0], "".join(parts) + row[1][last:]))
        elif not hit:
            expected.append(row[:2])
    assert sorted(map(repr, expected)) == sorted(repr((r.doc_id, r.text)) for r in got.collect())


def test_decontamination_of_empty_tables(spark, docs, rows, items):
    none = spark.createDataFrame([], "item_id long, text string")
    got = contamination.benchmark_hits(docs, none).collect()
    assert len(got) == len(rows) and not any(r.contaminated or r.n_items or r.spans for r in got)
    assert contamination.benchmark_hits(docs.limit(0), spark.createDataFrame(items, "item_id long, text string")).collect() == []
    assert contamination.decontaminate(docs, none).count() == len(rows)
    with pytest.raises(ValueError):
        contamination.decontaminate(docs, none, "words")
