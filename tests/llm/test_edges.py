"""Every operator over odd rows and empty tables: nothing breaks, and results are as the docstrings say."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plenumlens.llm import gif, jaccard, leaks, licenses, line_dedup, mixing, quality, repeats, slots, token_files

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def items_of(spark):
    return spark.createDataFrame([(1, "alpha0 beta1 no"), (1, "one"), (2, None), (None, "two words"), (3, ""), (4, "ONE")], "item_id long, text string")


def labels_of(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, 0, 1), (None, 1, 0), (5, None, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")


def tokens(df, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(df, path, TOKENIZER, shards=3)
    return token_files.document_facts(token_files.read_tokens(df.sparkSession, path))


RUNS = {
    "quality": lambda df, tmp: quality.with_score(df, quality.fit_field(df, labels_of(df.sparkSession), rounds=5)),
    "gif": lambda df, tmp: gif.with_payload(gif.with_frames(gif.with_media(df))),
    "tokens": tokens,
    "leaks": lambda df, tmp: leaks.with_hits(df, items_of(df.sparkSession)),
    "licenses": lambda df, tmp: licenses.scan(df),
    "jaccard": lambda df, tmp: jaccard.jaccard_classes(df),
    "lines": lambda df, tmp: line_dedup.dedup_lines(df),
    "mixing": lambda df, tmp: mixing.mix(df),
    "slots": lambda df, tmp: slots.assign_shards(df, 3, keep=df.columns),
    "repeats": lambda df, tmp: repeats.without_repeats(df),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_rows_stay(name, odd, odd_rows, tmp_path):
    got = RUNS[name](odd, tmp_path)
    assert len(set(got.columns)) == len(got.columns)
    rows = got.collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in odd_rows)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_empty_tables(name, empty, tmp_path):
    assert RUNS[name](empty, tmp_path).collect() == []


def test_other_tables_empty(spark, odd, odd_rows):
    none = items_of(spark).where("false")
    assert leaks.with_hits(odd, none).where("hits.n_hit > 0").count() == 0
    assert leaks.clean(odd.select("doc_id", "text"), none).count() == len(odd_rows)
    blank = quality.fit_field(odd, labels_of(spark).where("false"))
    assert {r.score for r in quality.with_score(odd, blank).collect()} == {0.5}
    assert licenses.scan(odd, templates=[]).where("n_licenses > 0").count() == 0


def test_equal_texts_get_equal_values(odd):
    prose = odd.where("doc_id in (1, 6)")
    for df, column in ((gif.with_payload(gif.with_media(prose)), "payload"), (repeats.without_repeats(prose), "kept_sha256"),
                       (jaccard.jaccard_classes(prose), "component_id")):
        assert df.select(column).distinct().count() == 1


def test_nulls_have_defined_results(odd):
    empty_hash = hashlib.sha256(b"").hexdigest()
    for r in repeats.without_repeats(odd).where("doc_id in (2, 3)").collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (0, 0, 0, empty_hash)
    for r in gif.with_payload(gif.with_media(odd.select("doc_id", "text"))).where("doc_id in (2, 3)").collect():
        assert (r.payload.payload_bytes, r.payload.payload_sha256) == (64, hashlib.sha256(bytes(64)).hexdigest())
    for r in jaccard.jaccard_classes(odd).where("doc_id in (2, 3, 4)").collect():
        assert (r.n_shingles, r.component_id) == (0, r.doc_id)
    for r in mixing.mix(odd).where("doc_id in (2, 3, 4)").collect():
        assert (r.size, r.taken) == (0, 0)
    assert {r.licenses for r in licenses.scan(odd).collect()} == {""}
    hits = {(r.doc_id, r.text): r.hits for r in leaks.with_hits(odd, items_of(odd.sparkSession)).collect()}
    assert hits[7, "ONE"]["items"] == ["1", "4"] and hits[2, None].n_words == 0
    assert {r.size for r in slots.assign_shards(odd, 3).where("doc_id in (2, 3)").collect()} == {8}


def test_token_files_are_exact(odd, odd_rows, tmp_path):
    plain = Tokenizer.from_file(TOKENIZER)
    got = [tuple(r) for r in tokens(odd, tmp_path).orderBy("start").collect()]
    want = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 0] for i, (_, t, *_) in enumerate(odd_rows)}
    assert [g[0] for g in got] == sorted((r[0] for r in odd_rows), key=lambda x: (x is not None, x))
    assert Counter((d, n, c) for d, _, n, c in got) == Counter(
        (odd_rows[i][0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in want.items())
    assert [g[1] for g in got] == list(np.cumsum([0, *[g[2] for g in got]])[:-1])


def test_kept_columns_of_the_pipeline_operators(odd, odd_rows):
    cleaned = leaks.clean(odd, items_of(odd.sparkSession), max_coverage=1.0)
    assert cleaned.columns == odd.columns and cleaned.count() == len(odd_rows)
    taken = mixing.take(odd)
    assert taken.columns == odd.columns and taken.where(F.length(F.trim("text")) == 0).count() == 0
