"""Merkle manifest, byte-level BPE and whitening against plain Python, other libraries and odd rows."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from plenumlens.llm import bpe, merkle, whitening
from plenumlens.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# --- Merkle manifest ---

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, more=0):
    chars = None if row.n_chars is None else row.n_chars + more
    values = (row.doc_id, row.source, row.lang, chars, row.text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree_of(nodes, arity):
    """The root, and for each leaf its (place, others) level by level."""
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, at in enumerate(own):
            run = nodes[at // arity * arity:][:arity]
            paths[leaf].append((at % arity, run[:at % arity] + run[at % arity + 1:]))
            own[leaf] = at // arity
        nodes = [sha("".join(nodes[i:i + arity])) for i in range(0, len(nodes), arity)]
    return nodes[0], paths


def proofs_of(rows, arity=2):
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r)))
        trees[lang] = tree_of([leaf_of(r) for r in groups[lang]], arity)
    root, tops = tree_of([trees[lang][0] for lang in langs], arity)
    found = Counter()
    for lang, top in zip(langs, tops, strict=True):
        for r, path in zip(groups[lang], trees[lang][1], strict=True):
            at = leaf_of(r, int(r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0))
            for place, others in path + top:
                at = sha("".join(others[:place] + [at] + others[place:]))
            proof = sha("".join(x for _, others in path + top for x in others))
            found[r.doc_id, leaf_of(r), trees[lang][0], root, proof, at, at == root] += 1
    return found


def manifest_of(docs, **options):
    tampered = F.crc32(docs.doc_id.cast("string").cast("binary")) % 7 == 0
    shown = {"n_chars": F.when(tampered, docs.n_chars + 1).otherwise(docs.n_chars)}
    return Counter(map(tuple, merkle.verify(merkle.manifest(docs, shown=shown, **options)).collect()))


@pytest.mark.parametrize("levels", [1, 3, 12])
def test_manifest(docs, levels):
    got = manifest_of(docs, block_levels=levels)
    assert got == proofs_of(docs.collect())
    assert {r[6] for r in got} == {True, False}


def test_wider_runs_and_odd_rows(spark, odd, odd_rows, docs):
    assert manifest_of(docs, arity=3, block_levels=2) == proofs_of(docs.collect(), 3)
    assert manifest_of(odd) == proofs_of(odd.collect())
    assert sum(manifest_of(odd).values()) == len(odd_rows)
    assert manifest_of(odd.limit(1)) == proofs_of(odd.limit(1).collect())


def test_no_rows_no_proofs(empty):
    assert merkle.verify(merkle.manifest(empty)).collect() == []


def test_a_changed_field_changes_the_root(docs):
    root = {r.root for r in merkle.manifest(docs).collect()}
    other = {r.root for r in merkle.manifest(docs.withColumn("source", F.when(F.col("doc_id") == 5, "x").otherwise(F.col("source")))).collect()}
    assert len(root) == len(other) == 1 and root != other


# --- BPE ---

@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check_codec(codec, library, texts):
    ids, sizes = codec.encode(texts)
    ends = np.cumsum(sizes)
    for text, a, b in zip(texts, ends - sizes, ends, strict=True):
        assert ids[a:b].tolist() == library.encode_ordinary(text), repr(text[:80])
        assert codec.decode(ids[a:b]).tobytes() == text.encode()


def test_odd_texts_are_encoded_as_by_the_library(library):
    rng = random.Random(1)
    bits = [" ", "  ", "\n", "\t", "\r\n", "a", "b", "'s", "'", "'ll", "é", "ł", "1", "٣", "!", "...", "\x1c", "\x85", "\xa0", " ", "😀", "中文",
            "​", "X" * 70, "ab" * 200, "́", "\x00", "xyz ", " \n "]
    texts = ["", " ", "  ", " a", "a ", "\n", "a\n", "\na", "a  b", " a  b "]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    check_codec(codec, library, texts)
    check_codec(codec, library, texts[::-1])


def test_long_pieces(library):
    rng = random.Random(2)
    texts = ["z" * 50_000, "".join(rng.choice("abcdefgh") for _ in range(50_000)), "中" * 20_000, " " * 30_000, "ab\n" * 2_000_000]
    check_codec(bpe.Codec(RANKS, public_tokenizers.PATTERN), library, texts)


def test_both_merges_agree():
    ranks, rng = bpe.Ranks(RANKS), random.Random(3)
    pieces = ["".join(rng.choice("aeiourstnl é中") for _ in range(rng.randrange(1, 20))).encode() for _ in range(500)]
    for piece in pieces:
        width = 1 << max(len(piece) - 1, 1).bit_length()
        rows = np.frombuffer(piece.ljust(width, b"\0"), np.uint8)[None, :]
        ids, sizes = bpe.merge_short(rows, np.array([len(piece)]), ranks)
        assert ids.tolist() == bpe.merge_long(piece, ranks) and sizes.tolist() == [len(ids)]


def test_tokens_that_no_merge_reaches(tmp_path):
    """A piece that is a token is this token; elsewhere only merges count."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bc", b"ab", b"cd"]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    check_codec(bpe.Codec(str(path), public_tokenizers.PATTERN), library, ["abc", "abcd", "abab", "abcabc", "cd bc abc", "abcbcd" * 30])


def test_codes_of_odd_rows(odd, odd_rows, empty, library):
    codes = bpe.with_ids(odd, RANKS, public_tokenizers.PATTERN)
    want = Counter((r[0], np.array(library.encode_ordinary(r[1] or ""), "<u4").tobytes()) for r in odd_rows)
    assert Counter((r.doc_id, bytes(r.ids)) for r in codes.collect()) == want
    back = bpe.decoded(codes, RANKS, public_tokenizers.PATTERN)
    assert Counter((r.doc_id, bytes(r.decoded)) for r in back.collect()) == Counter((r[0], (r[1] or "").encode()) for r in odd_rows)
    assert bpe.with_ids(empty, RANKS, public_tokenizers.PATTERN).collect() == []


def test_bpe_query(spark, docs, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op12_bpe"](spark, SF_DIR).collect()}
    for r in docs.collect():
        ids = library.encode_ordinary(r.text)
        assert got[r.doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(r.text))


# --- whitening ---

def whole(vectors):
    return np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000


def check_whitened(rows, ids, x, components=32):
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-9 * values[0]).sum()))
    assert Counter((r.vec_id, r.component) for r in rows) == Counter((i, c + 1) for i in ids for c in range(k))
    got = {}
    for r in rows:
        assert r.n == n and r.identity_error <= 1e-4
        assert abs(r.explained - values[r.component - 1] / values.sum()) <= 1e-6 * r.explained
        got.setdefault(r.vec_id, {})[r.component] = r.whitened
    want = centred @ vectors[:, :k] / np.sqrt(values[:k])
    mine = np.array([[got[i][c + 1] for c in range(k)] for i in ids])
    signs = np.sign((mine * want).sum(axis=0))
    assert np.abs(mine - want * signs).max() < 1e-6
    deviation = {r.vec_id: r.deviation for r in rows}
    assert [deviation[i] for i in ids] == ((n * x - sums) ** 2).sum(axis=1).tolist()


def test_whitening_query(spark):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    rows = QUERIES["op13_whitening"](spark, SF_DIR).collect()
    check_whitened(rows, [r.vec_id for r in table], whole([r.embedding for r in table]))


@pytest.mark.parametrize("shape", ["hot", "flat", "many parts"])
def test_whitening_of_hard_tables(spark, shape):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6)) * [3, 1, 1, 0.1, 2, 5]
    if shape == "hot":
        x[100:] = x[0]
    if shape == "flat":
        x[:, 3] = x[:, 1]
        x[:, 4] = 7
    df = spark.createDataFrame([(i, list(map(float, v)), "own") for i, v in enumerate(x)], "vec_id long, embedding array<double>, whitened string")
    rows = whitening.whitened(df.repartition(40 if shape == "many parts" else 3)).collect()
    check_whitened(rows, list(range(300)), whole(x))


def test_rows_without_a_valid_vector_are_dropped(spark):
    good = [[1.0, 2.0], [2.0, 1.0], [0.5, 0.25], [1.0, 2.0]]
    bad = [None, [], [1.0, None], [float("nan"), 1.0], [float("inf"), 0.0], [-1e300, 0.0], [1.0, 2.0, 3.0]]
    rows = [(i, v) for i, v in enumerate(good)] + [(10 + i, v) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    check_whitened(whitening.whitened(df).collect(), [0, 1, 2, 3], whole(good))
    assert whitening.whitened(df.where("false")).collect() == []
    assert whitening.whitened(df.where("vec_id >= 10 and vec_id < 16")).collect() == []
    assert whitening.whitened(df.where("vec_id in (0, 3)")).collect() == []  # equal rows vary in no direction
    repeated = spark.createDataFrame([(None, v) for v in good] + [(7, good[1])], "vec_id long, embedding array<double>")
    assert Counter(r.vec_id for r in whitening.whitened(repeated).collect()) == {None: 8, 7: 2}


def test_large_deviations():
    big = whitening.Whitening(3_000_000_000, [3_000_000_000 * 1_000_000] * 2, np.ones(1), np.ones((2, 1)), 1.0)
    assert big.deviations()(np.array([[1_000_000, 1_000_001], [1_000_900, 1_000_000]])) == [9_000_000_000_000_000_000, None]


def test_updates_keep_the_spectrum():
    rng = np.random.default_rng(5)
    for d, n in ((1, 20), (5, 3), (16, 60), (16, 400)):
        rows = whole(rng.normal(size=(n, d)))
        rows[::7] = rows[0]
        one, two = whitening.Spectrum.empty(d), whitening.Spectrum.empty(d)
        one.take(rows[: n // 2])
        two.take(rows[n // 2:])
        both = one.join(two)
        centred = rows - rows.mean(axis=0)
        scatter = centred.T @ centred
        assert np.allclose((both.vectors * both.values) @ both.vectors.T, scatter, atol=1e-9 * max(1, scatter.max()))
        assert np.allclose(both.vectors.T @ both.vectors, np.eye(d), atol=1e-12)
        assert both.sums.tolist() == rows.sum(axis=0).tolist()
