"""Operators against plain Python over whole small tables."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenumlens.llm import gif, graph, jaccard, leaks, licenses, line_dedup, mixing, quality, repeats, slots, token_files


LARGER = "/root/testdata/sf0.01"


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- 1: quality ---

@pytest.mark.skipif(not os.path.isdir(LARGER), reason="driver tables not present")
def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{LARGER}/{name}.parquet") for name in ("documents", "labels"))
    field = quality.fit_field(docs, labels)
    scored = quality.with_score(docs, field).withColumn("held_out", quality.held_out(F.col("doc_id")))
    rows = scored.join(labels, "doc_id").collect()
    assert {r.held_out for r in rows} == {zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows}
    right = [(r.score >= quality.THRESHOLD) == (r.quality == 1) for r in rows if r.held_out]
    assert len(right) > 50 and sum(right) / len(right) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(3)
    field = quality.LineField(rng.normal(size=(3, quality.FEATURES, quality.BINS)), 0.3, rng.normal(size=(2, 2)))
    for lines in (1, 2, 5):
        bins = rng.integers(0, quality.BINS, (lines, quality.FEATURES)).astype(np.uint8)
        chains, _ = quality.Chains.of(bins, np.array([lines]))
        odds, (sure, expected) = field.emissions(chains), field.marginals(chains)
        weight, good, moves = 0.0, np.zeros(lines), np.zeros((2, 2))
        for code in range(1 << lines):
            y = [code >> i & 1 for i in range(lines)]
            w = np.exp(sum(o for o, v in zip(odds, y, strict=True) if v) + sum(field.moves[a, b] for a, b in zip(y, y[1:])))
            weight += w
            good += w * np.array(y)
            for a, b in zip(y, y[1:]):
                moves[a, b] += w
        assert np.allclose(sure, good / weight) and np.allclose(expected, moves / weight)


# --- 2: GIF ---

@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 70_000, 140_000])
def test_payload_round_trip(n):
    for text in (os.urandom(n), bytes(n), b"ab" * (n // 2)):
        payload = gif.padded(text)
        assert payload[:len(text)] == text and len(payload) % 64 == 0 and payload
        frames = [(f.samples.tobytes(), f.delay) for f in gif.read_gif(gif.write_gif(payload))]
        assert b"".join(s for s, _ in frames) == payload and {d for _, d in frames} == {gif.DELAY}


@pytest.mark.parametrize("bits", [2, 3, 5, 8])
def test_code_streams(bits):
    rng = random.Random(bits)
    for n in (0, 1, 5, 1000, 60_000):
        samples = bytes(rng.randrange(1 << bits) for _ in range(n))
        assert gif.lzw_unpack(gif.lzw_pack(samples, bits), bits, n) == samples
        assert samples.startswith(gif.lzw_unpack(gif.lzw_pack(samples, bits)[:-3], bits, n))


def bit_stream(codes, low_bits):
    """Codes of a writer that never clears: the width grows with the table and stays at 12."""
    bits, count = "", 0
    for code in codes:
        free = (1 << low_bits) + 2 + max(0, count - 1)
        width = min(12, max(low_bits + 1, free.bit_length()))
        bits = format(code, f"0{width}b") + bits
        count = 0 if code == 1 << low_bits else count + 1
    return int(bits, 2).to_bytes(len(bits) // 8 + 1, "little")


def test_table_that_is_never_cleared():
    rng = random.Random(1)
    samples = [rng.randrange(4) for _ in range(30_000)]
    table, codes, run = {(i,): i for i in range(4)}, [4], ()
    for s in samples:
        if (*run, s) in table:
            run = (*run, s)
            continue
        codes.append(table[run])
        if len(table) + 2 < gif.TABLE:
            table[(*run, s)] = len(table) + 2
        run = (s,)
    codes += [table[run], 5]
    assert gif.lzw_unpack(bit_stream(codes, 2), 2, len(samples)) == bytes(samples)


def picture(frames, width=4, height=4, palette=((255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 255))):
    out = b"GIF89a" + bytes([width, 0, height, 0, 0x81, 0, 0]) + b"".join(bytes(c) for c in palette)
    for left, top, w, h, samples, disposal, clear, flags, local in frames:
        out += b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None), 7, 0, clear or 0, 0])
        out += b"\x21\xfe\x03abc\x00" + b"\x2c" + bytes([left, 0, top, 0, w, 0, h, 0, flags]) + local + b"\x02"
        packed = gif.lzw_pack(bytes(samples), 2)
        out += bytes([len(packed)]) + packed + b"\x00"
    return out + b"\x3b"


def test_drawing_rules():
    red, green, blue = 0xFF0000FF, 0xFF00FF00, 0xFFFF0000
    full = (0, 0, 4, 4, [0] * 16, 1, None, 0, b"")
    patch = [1, 1, 2, 2, [1, 2, 2, 1], 0, 2, 0, b""]
    seen = {}
    for disposal in (1, 2, 3):
        patch[5] = disposal
        drawn = [f.canvas.copy() for f in gif.read_gif(picture([full, tuple(patch), (0, 0, 1, 1, [2], 1, None, 0, b"")]))]
        assert (drawn[0] == red).all() and drawn[1][1, 1] == green and drawn[1][1, 2] == red and drawn[2][0, 0] == blue
        seen[disposal] = drawn[2][1, 1]
    assert seen == {1: green, 2: 0, 3: red}
    rows = [r for r in range(4) for _ in range(4)]  # interlaced: file rows 0, 2, 1, 3 are drawn rows 0, 4..: here 0, 2, 1, 3
    woven = next(gif.read_gif(picture([(0, 0, 4, 4, rows, 1, None, 0x40, b"")])))
    assert woven.samples[:, 0].tolist() == [0, 2, 1, 3]
    own = next(gif.read_gif(picture([(0, 0, 4, 4, [0] * 16, 1, None, 0x80, bytes([1, 2, 3, 0, 0, 0]))])))
    assert (own.canvas == 0xFF030201).all() and own.delay == 7
    counts = gif.histogram(np.array([[red, green, 0, blue]], np.uint32))
    assert (counts[48], counts[12], counts[3], counts[64]) == (1, 1, 1, 1)
    assert list(gif.read_gif(b"")) == list(gif.read_gif(b"GIF89a")) == list(gif.read_gif(os.urandom(99))) == []


def test_frames_column(spark):
    text = "x" * (gif.WIDTH * gif.FRAME_ROWS + 100)
    row = gif.with_frames(gif.with_media(spark.createDataFrame([(text,)], "text string"))).first()
    assert [(f.start_cs, f.delay_cs, f.width) for f in row.frames] == [(0, 10, 64), (10, 10, 64)]
    assert [sum(f.histogram) for f in row.frames] == [64 * 1024, 64 * 1024]


# --- 3: token files ---

def test_files_prune_and_carry_indexes(spark, docs, tmp_path):
    import public_tokenizers
    import pyarrow.parquet as pq

    for dictionary in (True, False):
        path = str(tmp_path / f"t{dictionary}")
        token_files.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), shards=2, dictionary=dictionary)
        files = sorted(p for p in os.listdir(path) if p.endswith(".parquet"))
        meta = pq.ParquetFile(f"{path}/{files[0]}").metadata.row_group(0)
        columns = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
        assert all(c.has_offset_index and c.has_column_index for c in columns.values())
        ids = next(c for n, c in columns.items() if n.startswith("ids"))
        assert ids.has_dictionary_page == dictionary and ("DELTA_BINARY_PACKED" in ids.encodings) != dictionary
        assert "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings
    tokens = token_files.read_tokens(spark, path)
    plan = tokens.where("doc_id = 7").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,7)" in plan and "ids" not in plan.split("ReadSchema")[1]
    parts = token_files.manifest(tokens).orderBy("shard").collect()
    assert [p.start for p in parts] == list(np.cumsum([0, *[p.tokens for p in parts]])[:-1])


# --- 4: decontamination ---

def hits_of(texts, items, span=10):
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", fold(t))
    windows = defaultdict(set)
    for name, text in items:
        w = words(text)
        n = min(span, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k:k + n])].add(name)
    out = []
    for text in texts:
        w, found = words(text), set()
        hit = [0] * len(w)
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit[k:k + n] = [1] * n
                    found |= {x for x in windows[tuple(w[k:k + n])] if x is not None}
        out.append((len(w), sum(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block_words", [10, 300_000])
def test_hits(spark, block_words):
    rng = random.Random(8)
    draw = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    items = [(str(i), draw(rng.choice([0, 1, 3, 9, 10, 11, 14]))) for i in range(25)] + [(None, draw(12)), ("x", None), ("1", draw(11))]
    texts = [draw(rng.randrange(60)) + rng.choice(["", ", C'est-à-dire!"]) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    bank = spark.createDataFrame(items, "item_id string, text string")
    got = leaks.with_hits(df, bank, block_words=block_words).orderBy("doc_id").collect()
    assert [(r.hits.n_words, r.hits.n_hit, r.hits["items"]) for r in got] == hits_of(texts, items)


def test_clean_texts_have_no_hit(spark, docs):
    items = spark.createDataFrame([(1, "b c d e f g h i j k"), (2, "A1 B2 c3"), (3, "p q")], "item_id long, text string")
    rows = [(1, "x b c d, e f g h i j k y z"), (2, "a a1 a1 b2 c3 b2 c3"), (3, "nothing here"), (4, None), (5, "p q p q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cleaned = leaks.clean(df, items, max_coverage=0.9)
    got = {r.doc_id: r.text for r in cleaned.collect()}
    assert got[1].split() == ["x", "y", "z"] and got[2].split() == ["a", "a1", "b2", "c3"][:0] + got[2].split()
    assert got[3] == "nothing here" and got[4] is None and 5 not in got
    assert leaks.with_hits(cleaned, items).where("hits.n_hit > 0").count() == 0


# --- 5: licenses ---

def test_licenses(spark):
    rows = []
    for i, (name, notice) in enumerate(licenses.TEMPLATES):
        words = notice.split()
        rows += [(10 * i + k, f"{'lorem ipsum ' * k}{notice.upper() if k % 2 else notice}{' dolor' * 40}", name) for k in range(9)]
        if len(words) > 24:  # a word changed in a long notice leaves enough of it
            rows.append((10 * i + 9, " ".join([*words[:2], "else", *words[3:]]), name))
    rows.append((999, "Licensed works and a license, version 3, with an Apache in it", ""))
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, want string")).collect()}
    assert got == {i: want for i, _, want in rows}


def test_bands_guarantee_a_meeting():
    for n in (5, 8, 20):
        bands = licenses.bands_for([n])
        m = n - 4
        share = 0.8 * m / (2 * licenses._step(n) - 4 + 0.2 * m)
        assert (1 - share) ** bands <= licenses.MISS


# --- 6: Jaccard join ---

def classes_of(texts, length=5, percent=80):
    sets = []
    for text in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
        sets.append({tuple(w[i:i + length]) for i in range(max(1, len(w) - length + 1))} if w else set())
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    return [(len(s), g) for s, g in zip(sets, group, strict=True)]


def near_texts(rng, bases, copies, words=60):
    out = []
    for _ in range(bases):
        base = [rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(rng.randrange(1, words))]
        out.append(" ".join(base))
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = "w" + str(rng.randrange(999))
            out.append(" ".join(copy[rng.randrange(2):]))
    return out


def test_jaccard_classes(spark, docs, monkeypatch):
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(30))
    for hot in (jaccard.HOT, 3):  # a low bound puts the counted path to work on few rows
        monkeypatch.setattr(jaccard, "HOT", hot)
        texts = near_texts(rng, 12, 9) + [f"{passage} {' '.join(t.split()[:12])}" for t in near_texts(rng, 15, 1)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
        got = [(r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(df).orderBy("doc_id").collect()]
        assert got == classes_of(texts)
    rows = docs.orderBy("doc_id").collect()
    got = [(r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(docs).orderBy("doc_id").collect()]
    assert got == [(n, rows[g].doc_id) for n, g in classes_of([r.text for r in rows])]


def test_large_group_is_joined_without_all_pairs(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base)]
    for i in range(300):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3, 5])):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(df).orderBy("doc_id").collect()]
    assert got == classes_of(texts)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(None, 3), (5, 5)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    group = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for a, b in edges:
        if a in group and b in group and group[a] != group[b]:
            low, high = sorted((group[a], group[b]))
            group = {k: low if g == high else g for k, g in group.items()}
    assert got == group
    assert graph.components(spark.createDataFrame([], "u long, v long")).collect() == []


# --- 7: line dedup ---

def lines_of(rows):
    place, cut = {}, [[tuple(x.lower().split()) for x in (t or "").encode().split(b"\n")] for _, t in rows]
    for i in sorted(range(len(rows)), key=lambda i: rows[i][0]):
        for no, words in enumerate(cut[i]):
            if words:
                place.setdefault(words, (rows[i][0], no))
    near = {a for a in place for b in place if place[b] < place[a] and min(len(a), len(b)) >= 5 and line_dedup.within_one(list(a), list(b))}
    out = {}
    for (key, text), words in zip(rows, cut, strict=True):
        lines = (text or "").encode().split(b"\n")
        keep = [x for no, (x, w) in enumerate(zip(lines, words, strict=True)) if not w or (w not in near and place[w] == (key, no))]
        kept = b"\n".join(keep)
        out[key] = (len(lines), len(lines) - len(keep), len(kept), hashlib.sha256(kept).hexdigest())
    return out


def test_lines(spark):
    rng = random.Random(2)
    line = lambda: " ".join(rng.choice("abc") for _ in range(rng.randrange(9)))
    rows = [(i, "\n".join(line() for _ in range(rng.randrange(6)))) for i in range(120)] + [(301, None), (302, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_bytes, r.kept_sha256) for r in line_dedup.dedup_lines(df).collect()}
    assert got == lines_of(rows)


def test_near_lines_share_half_and_variant():
    rng = random.Random(3)
    for _ in range(400):
        a = [rng.choice(b"abcd").to_bytes() for _ in range(rng.randrange(5, 12))]
        b, at = list(a), rng.randrange(len(a))
        b[at:at + rng.choice([0, 1])] = rng.choice([[], [b"z"]])
        assert line_dedup.within_one(a, b)
        assert set(line_dedup.halves(a)) & set(line_dedup.halves(b))
        assert set(line_dedup.variants(a).tolist()) & set(line_dedup.variants(b).tolist())


# --- 8: mixing ---

def quotients(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


def test_apportionment_is_by_highest_quotients(spark):
    rng = random.Random(9)
    for seats in (0, 1, 7, 100, 1003):
        votes = [rng.choice([0, 1, 5, 5, 40, rng.randrange(100_000)]) for _ in range(12)] + [10]
        df = spark.createDataFrame([(0, i, v, seats) for i, v in enumerate(votes)], "g int, i int, v long, seats long")
        got = [r.quota for r in mixing.apportion(df, ["g"], "v", "seats", ["i"]).orderBy("i").collect()]
        assert got == quotients(votes, seats)


def test_targets_and_taken(spark):
    rng = random.Random(7)
    sizes = {"a": 40_000, "b": 9_000, "c": 900, "d": 100, None: 5_000, "é": 0}
    rows = [(f"{s}{i}", " ".join("w" * n), s) for s, total in sizes.items() for i, n in enumerate([rng.randrange(1, 50) for _ in range(total // 25)] or [0])]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string")
    got = mixing.mix(df, keep=["doc_id", "source"], block=8, shard_docs=100).collect()
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size and r.source_size >= r.size
    want, open_, total = {}, ["a", "b", "c", "d", "é", None], sum(size.values())
    weight = dict(zip(open_, [5, 2, 1, 5, 2, 1], strict=True))
    while True:
        left = total - sum(want.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * size[s]]
        if not over:
            break
        want |= {s: 3 * size[s] for s in over}
        open_ = [s for s in open_ if s not in over]
    want |= share
    assert all(abs(target[s] - want[s]) < 1e-6 * total for s in want)
    shards = {s: -(-n // 100) for s, n in Counter(r.source for r in got).items()}
    assert all(abs(taken[s] - want[s]) <= 8 * (1 + 3 * shards[s]) for s in want)
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(7), block=8, shard_docs=100).collect()}
    assert again == {r.doc_id: r.taken for r in got}


# --- 9: sharding ---

def test_shards_are_even_and_gapless(docs):
    got = slots.assign_shards(docs.union(docs), 24).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    loads = [sum(r["size"] for r in rows) for rows in by.values()]
    assert set(by) == set(range(24)) and max(loads) - min(loads) <= max(r["size"] for r in got)
    assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in by.values())
    assert len({(r.vslot, r.shard) for r in got}) == len({r.vslot for r in got})


def test_map_is_edited_by_few_moves(spark):
    rng = random.Random(1)
    weights = {i: rng.randrange(1, 100) for i in range(300)}
    sizes = spark.createDataFrame(list(weights.items()), "vslot int, bytes long")
    first = slots.first_map(sizes, 6)
    old = {r.vslot: r.shard for r in first.collect()}
    grown = slots.edit_map(first, sizes, 7).collect()
    new = {r.vslot: r.shard for r in grown}
    load = Counter()
    for slot, shard in new.items():
        load[shard] += weights[slot]
    assert {r.version for r in grown} == {2} and set(new) == set(weights) and set(load) == set(range(7))
    assert max(load.values()) - min(load.values()) <= 100
    moved = sum(weights[s] for s in new if new[s] != old[s])
    assert moved <= 1.3 * sum(weights.values()) / 7
    fewer = {r.vslot: r.shard for r in slots.edit_map(spark.createDataFrame(grown), sizes, 5).collect()}
    assert set(fewer.values()) == set(range(5))


# --- 10: repeats ---

def cut_of(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [20, 200])
def test_repeats(spark, length):
    rng = random.Random(length)
    pieces = ["".join(rng.choice("abé") for _ in range(length)) for _ in range(7)]
    texts = ["".join(rng.choice(pieces)[:rng.randrange(length)] for _ in range(rng.randrange(30))) for _ in range(70)]
    texts += [None, "", "a" * 500, "a" * (length - 1), "ab" * 300, "x" * length, "x" * length, pieces[0] + "q" + pieces[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = [tuple(r)[1:] for r in repeats.without_repeats(df, length=length).orderBy("doc_id").collect()]
    assert got == cut_of([(t or "").encode() for t in texts], length)


@pytest.mark.parametrize("length", [20, 200])
def test_repeats_of_anchors_that_occur_often(spark, monkeypatch, length):
    most, matcher = 40, repeats._matcher

    def watched(length):
        run = matcher(length)

        def bounded(batches):
            seen = Counter()
            for batch in batches:
                seen.update(batch.column(0).to_pylist())
                assert max(seen.values(), default=0) <= most, "one task gathers an anchor"
                yield batch

        return lambda batches: run(bounded(batches))

    monkeypatch.setattr(repeats, "GATHERED", most, raising=False)
    monkeypatch.setattr(repeats, "OFTEN", 100, raising=False)
    monkeypatch.setattr(repeats, "_matcher", watched)
    rng = random.Random(length)

    def own(n):
        return "".join(rng.choice("abcdefgh é") for _ in range(n))

    shared, few = own(3 * length), own(2 * length)
    texts = [own(rng.randrange(2 * length)) + shared + own(rng.randrange(2 * length)) for _ in range(150)]
    # cut short, within one text twice, with edges that some share, periodic
    texts += [own(length) + shared[i:2 * length + i] + own(5) for i in range(0, length, 7)] + [own(9) + few + own(9) for _ in range(5)]
    texts += [shared + own(3) + shared, "same" + shared + "same", "same" + shared + "other", "same" + shared, "a" * 4000, "ab" * 900, None, "", shared, shared]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = [tuple(r)[1:] for r in repeats.without_repeats(df, length=length).orderBy("doc_id").collect()]
    assert got == cut_of([(t or "").encode() for t in texts], length)


def test_repeats_over_the_table(docs):
    rows = docs.orderBy("doc_id").collect()
    got = [tuple(r)[1:] for r in repeats.without_repeats(docs).orderBy("doc_id").collect()]
    assert got == cut_of([r.text.encode() for r in rows], 200)


def test_suffix_sort(monkeypatch):
    rng = random.Random(5)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(300)]
    group = np.sort(np.array([rng.randrange(9) for _ in strings]))
    rows = np.array([list(s.ljust(12, b"\0")) for s in strings], np.uint8)
    sizes = np.array([len(s) for s in strings])
    want = sorted(range(300), key=lambda i: (group[i], strings[i], i))
    for deceived in (False, True):
        found = repeats.Suffixes(rows, sizes)
        if deceived:  # hashes that are all equal: the check on the bytes must notice
            found.hashes[:] = 0
        order, common = found.sorted_common(group)
        assert [strings[i] for i in order] == [strings[i] for i in want]
        for k in range(1, 300):
            a, b = order[k - 1], order[k]
            same = os.path.commonprefix([strings[a], strings[b]])
            assert common[k] == (len(same) if group[a] == group[b] else -1)
