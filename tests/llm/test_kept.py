"""Extra columns whose names the operators use themselves."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from riskspark.llm import compression, html_crf, langid, mixing, pieces, quality_fm, tokens

CLASHING = "__text __html __url __declared __DECLARED_KEY __source __tokens __hash __block __key __n __p __label weight whole rotation b_start kept_3".split()
TEXT = "one two three four five six seven eight nine ten eleven twelve"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"{TEXT} {i}" if i % 5 else None, f"s{i % 3}" if i % 4 else None, "<article><p>a b</p></article>", "http://x.de/") for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, html string, url string")
    return frame.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])


def _model(spark):
    rows = [(i, f"{TEXT} {i}", i % 2) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    return quality_fm.train(frame.drop("label"), frame.select("doc_id", "label"))


@pytest.mark.parametrize("name", ["tokens", "quality", "mixing", "language", "pages", "compression", "pieces"])
def test_columns_named_like_helpers(spark, docs, name):
    plain, given = docs.drop(*CLASHING), docs
    run = {
        "tokens": lambda d: tokens.token_counts(d, public_tokenizers.path("word_bpe_49k.json")),
        "quality": lambda d, m=_model(spark) if name == "quality" else None: quality_fm.score(d, m),
        "mixing": lambda d: mixing.temperature_mix(d, mixing.Target(entropy=0.9, repetition=2.0, budget=None)),
        "language": lambda d: langid.identify(d, langid.train(plain.select("doc_id", "text", F.lit("en").alias("lang")))),
        "pages": lambda d: html_crf.extract_main_text(d, html_crf.fit([])),
        "compression": compression.compression_rules,
        "pieces": lambda d: pieces.encode_documents(d, public_tokenizers.path("piece_bpe_32k.model"), with_texts=False),
    }[name]
    want, got = run(plain), run(given)
    made = set(want.columns)
    kept = [c for c in CLASHING if c not in made]
    assert len(got.columns) == len(set(got.columns)) and set(got.columns) == made | set(kept)
    rows = got.collect()
    if name != "mixing":  # there rows are drawn by a hash of all columns
        assert len(rows) == 30
        assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    assert {r.doc_id for r in rows} == set(range(30))
    assert all(r[c] == f"{c}:{r.doc_id}" for r in rows for c in kept)
