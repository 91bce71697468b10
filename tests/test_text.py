"""Text columns against the properties and independent counts in spec.py."""

import html
import random

import pytest
import spec
from pyspark.sql import functions as F

from plenumlens.functions import automaton, base, fields, keywords as kw, text as tx
from plenumlens.functions import html as hx
from plenumlens.operators import fragments as fr
from plenumlens.operators import matching

REFERENCES = [
    "&amp;", "&amp", "&lt;b&gt;", "&notit;", "&frac12x", "&#65;", "&#x41", "&#0;", "&#128;", "&#x81;", "&#xD800;",
    "&#99999999999999;", "&nbsp;", "&copy", "&NotEqualTilde;", "&xyz;", "& ", "&&&", "ab ", "é", "😀", "&#11;", "&#13;",
    "&#xFDD0;", "&#x1FFFF;", "&#38;lt;", " ", "\x1c", "&apos;", "&&lt;", "&;", "&#;", "&#x;",
]
WORDS = [
    "a", "bb", "żart", "żartem", "humorem", "Humoru", "kryzysu", "ha, ha, ha", "ha,", "ha", "słowo, ", ". ", "! ", "? ",
    ".", "x" * 50, "😀", "é", "é", " ", "  ", "brawo wspaniale", "brawo", "uuu", "uuuu", "&amp;", "&", "<b>",
    "</p>", "\n", "łódź",
]


def texts(pieces, n, most, seed):
    random.seed(seed)
    return [""] + [
        "".join(random.choice(pieces) + random.choice([" ", ""]) for _ in range(random.randint(0, most))) for _ in range(n)
    ]


def frame(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "i int, text string")


def test_references_and_normalizing(spark):
    rows = texts(REFERENCES, 400, 8, 1)
    got = frame(spark, rows).select(
        "i", hx.unescape(F.col("text")).alias("u"), tx.normalize_text(F.col("text")).alias("n")
    ).collect()
    assert {r.i: r.u for r in got} == {i: html.unescape(t) for i, t in enumerate(rows)}
    assert {r.i: r.n for r in got} == {i: spec.normalized(t) for i, t in enumerate(rows)}


@pytest.mark.parametrize("limit", [25, 80, 500])
def test_segments_and_fragments(spark, limit):
    rows = texts(WORDS, 250, 40, limit)
    lexicon = kw.make_lexicon([*kw.DEFAULT_LEXICON, ("żart", 9.0)])
    df = frame(spark, rows)
    cut = {r.i: r.segments for r in fr.segment_statements(df, ["i"], limit=limit).collect()}
    found = {}
    for r in fr.extract_fragments(df, lexicon, ["i"], limit=limit).orderBy("i", "segment_idx").collect():
        found.setdefault(r.i, []).append(r)
    for i, raw in enumerate(rows):
        text = spec.normalized(spec.cleaned(raw))
        spec.check_segments(text, cut[i], limit)
        spec.check_fragments(text, cut[i], found.get(i, []), [(k.keyword, k.weight) for k in lexicon], kw.SUFFIXES)


@pytest.mark.parametrize("text,limit,parts", [
    ("aa bb. cc! dd? ee", 9, ["aa bb.", "cc!", "dd?", "ee"]),
    ("aaaa, bbbb, cccc, dddd", 11, ["aaaa, bbbb", "cccc, dddd"]),
    ("aaaa bbbb cccc dddd", 10, ["aaaa bbbb", "cccc dddd"]),
    ("aa, bb cc dd ee ff", 8, ["aa", "bb cc dd", "ee ff"]),
    ("x" * 12, 5, ["x" * 12]),
    ("a 3.5 b", 20, ["a 3.5 b"]),
])
def test_packing(spark, text, limit, parts):
    row = fr.segment_statements(frame(spark, [text]), ["i"], limit=limit).first()
    assert [s.body for s in row.segments] == parts


def test_long_text_offsets(spark):
    text = " ".join(f"Zdanie numer {i}." for i in range(700))
    row = fr.segment_statements(frame(spark, [text]), ["i"]).first()
    assert len(row.segments) == 700
    spec.check_segments(spec.normalized(text), row.segments, 500)


def test_known_values(spark):
    lexicon = kw.make_lexicon(kw.DEFAULT_LEXICON)
    rows = [
        "To był żart, a potem drugi żart i trochę humoru.",
        "<p>Mówca odpowiedział z humorem &amp; usiadł.</p>",
        "Komisja zajęła się skutkami kryzysu w rolnictwie.",
    ]
    df = frame(spark, rows)
    segments = fr.explode_segments(fr.segment_statements(df, ["i"]), ["i"])
    weight = {k.keyword: k.weight for k in reversed(lexicon)}
    scores = {r.i: r.score for r in fr.score_segments(segments, lexicon).collect()}
    for i, raw in enumerate(rows):
        text = spec.normalized(spec.cleaned(raw))
        assert scores[i] == sum(spec.lenient_count(text, k.keyword, kw.SUFFIXES) * k.weight for k in lexicon)
    found = {r.i: r for r in fr.extract_fragments(df, lexicon, ["i"]).collect()}
    assert set(found) == {0, 1} and found[0].score == 2 * weight["żart"] and found[1].score == weight["humorem"]
    assert found[1].text == "mówca odpowiedział z humorem i usiadł."
    assert not fr.score_audit(fr.extract_fragments(df, lexicon, ["i"])).where("mismatch").count()


def test_window_keeps_its_hit(spark):
    text = "w" * 449 + ". " + "v" * 400 + " humor."
    lexicon = kw.make_lexicon([("humor", 2.0)])
    whole = {r.segment_idx: r.score for r in fr.extract_fragments(frame(spark, [text]), lexicon, ["i"]).collect()}
    assert whole == {1: 2.0}
    short = fr.extract_fragments(frame(spark, [text]), lexicon, ["i"], cut_at=500).first()
    assert short.score == 0.0 and short.end_offset - short.start_offset <= 500


def test_audit_finds_wrong_scores(spark):
    lexicon = kw.make_lexicon([("humor", 2.0), ("żart", 1.0)])
    found = fr.extract_fragments(frame(spark, ["Humor i żart.", "Tylko żart.", "Humor, humor."]), lexicon, ["i"])
    wrong = found.withColumn("score", F.when(F.col("i") == 1, F.col("score") + 0.5).otherwise(F.col("score")))
    assert [r.i for r in fr.score_audit(wrong).where("mismatch").collect()] == [1]
    recounted = found.withColumn("matched_keywords", F.transform("matched_keywords", lambda m: m.withField("count", m["count"] + (F.col("i") == 2).cast("int"))))
    assert [r.i for r in fr.score_audit(recounted).where("mismatch").collect()] == [2]


@pytest.mark.parametrize("size", [kw.UNROLLED, kw.UNROLLED + 1])
def test_lexicons_of_any_size(spark, size):
    fill = [(f"słowo{i}", 1.0) for i in range(size - 4)]
    lexicon = kw.make_lexicon([("humor", 1.0), ("brawo wspaniale", 2.0), *fill, ("żart", 2.0), ("c++", 1.0)])
    rows = texts([*WORDS, "humor", "c++", "słowo7", "słowo200"], 60, 25, 9)
    got = fr.extract_fragments(frame(spark, rows), lexicon, ["i"]).orderBy("i", "segment_idx").collect()
    few = kw.make_lexicon([("humor", 1.0), ("brawo wspaniale", 2.0), ("słowo7", 1.0), ("słowo200", 1.0), ("żart", 2.0), ("c++", 1.0)])
    same = fr.extract_fragments(frame(spark, rows), few, ["i"]).orderBy("i", "segment_idx").collect()
    assert got == same


FILL = [(f"słowo{i}", 1.0) for i in range(kw.UNROLLED)]


@pytest.mark.parametrize("shape", [{}, {"context": 0}, {"context": 2}, {"cut_at": 40}])
def test_windows_of_a_large_lexicon_are_those_of_patterns(spark, shape):
    some = [("humor", 1.0), ("Humor", 4.0), ("brawo wspaniale", 2.0), ("humor, żart", 0.5), ("żart", 2.0), ("zart", 0.25), ("c++", 1.0), ("humor", 9.0), ("d.", 3.0)]
    rows = [*texts([*WORDS, "humor", "żart", "z\u0301art", "c++", "d", "humorem"], 60, 25, 3), "", "humor", ". . humor. żart"]
    large = fr.extract_fragments(frame(spark, rows), kw.make_lexicon(some + FILL), ["i"], limit=30, **shape)
    few = fr.extract_fragments(frame(spark, rows), kw.make_lexicon(some), ["i"], limit=30, **shape)
    got = large.orderBy("i", "segment_idx").collect()
    assert got == few.orderBy("i", "segment_idx").collect() and any(len(r.matched_keywords) > 2 for r in got)


def test_windows_of_words_are_not_counted_again(spark):
    def passes(lexicon):
        found = fr.extract_fragments(frame(spark, ["humor"]), kw.make_lexicon(lexicon), ["i"])
        return found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")

    assert passes([("humor", 1.0), *FILL]) == 1 and passes([("brawo wspaniale", 1.0), *FILL]) == 2


@pytest.mark.parametrize("lenient", [False, True])
def test_table_and_automaton_agree(lenient):
    lexicon = [kw.Keyword(i, k) for i, k in enumerate(["a", "A", "ab", "ał", "a b", "b.", "_", "2", "abow", "ab", "²"])]
    rng = random.Random(5)
    rows = ["".join(rng.choice("aabbłuow_2² .\u0301é") for _ in range(rng.randrange(40))) for _ in range(400)]
    table, walk = automaton.Counter(lexicon, lenient), automaton.Counter(lexicon, lenient, table_words=0)
    assert table.table and not walk.table
    assert [table.matches(t) for t in rows] == [walk.matches(t) for t in rows] and any(len(table.matches(t)) > 3 for t in rows)
    together = zip(*(x.tolist() for x in table.counts(rows)))
    assert [*together] == [(i, e, n) for i, t in enumerate(rows) for e, n in table.matches(t)]


def counts(spark, text, lexicon, match):
    entries = kw.make_lexicon(lexicon)
    row = frame(spark, [text]).select(match(F.col("text"), entries).alias("m")).first()
    return {m["keyword"]: m["count"] for m in row.m}


def test_lenient_counts(spark):
    assert counts(spark, "Drogi most, mosty i mostek. drogowiec", [("most", 2.0), ("drogi", 1.5)],
                  kw.lenient_matches) == {k: n for k in ("most", "drogi")
                                          if (n := spec.lenient_count("Drogi most, mosty i mostek. drogowiec", k, kw.SUFFIXES))}
    assert counts(spark, "Stanął tu zielony wóz straży.", [("zielony wóz", 3.0)], kw.lenient_matches) == {"zielony wóz": 1}
    assert counts(spark, "Lampa lampa? Lampa!", [("lampa", 2.0)], kw.lenient_matches) == {"lampa": 3}
    assert counts(spark, "nic", [], kw.lenient_matches) == {}


def test_boundaries_next_to_punctuation(spark):
    lexicon = [("c++", 1.0), ("ha, ha", 1.0), ("żart", 1.0)]
    text = "c++ ac++b c++x ha, ha, ha żart łżart żart_ (żart)"
    got = counts(spark, text, lexicon, kw.strict_matches)
    assert got == {k: spec.strict_count(text, k) for k, _ in lexicon if spec.strict_count(text, k)}


@pytest.mark.parametrize("lenient", [False, True])
def test_large_lexicon_join_equals_literals(spark, lenient):
    lexicon = kw.make_lexicon([("a", 1.0), ("bb a", 2.0), ("ha, ha, ha", 1.5), ("żart", 2.0), ("humor", 1.0),
                               ("brawo wspaniale", 1.0), ("uuu", 1.0), ("c++", 1.0)])
    rows = texts([*WORDS, "a", "bb", "c++"], 150, 30, 5)
    segments = fr.explode_segments(fr.segment_statements(frame(spark, rows), ["i"]), ["i"])
    table = spark.createDataFrame([(k.ord, k.keyword, k.weight) for k in lexicon], "ord int, keyword string, weight double")
    keys = ["i", "segment_idx"]
    by_join = matching.match_keywords(segments, table, keys, lenient=lenient)
    literal = matching.literal_matches(segments, lexicon, keys, lenient=lenient)
    assert sorted(map(tuple, by_join.collect())) == sorted(map(tuple, literal.select(by_join.columns).collect()))


def test_blocks_of_a_lexicon_are_one_lexicon(spark):
    entries = [(i, f" słowo{i % 50} " if i < 60 else ["", " ", None][i % 3], float(i)) for i in range(63)]
    table = spark.createDataFrame(entries, "ord int, keyword string, weight double")
    segments = spark.createDataFrame([(i, f"słowo{i} i słowo{i + 1}, słowo{i}") for i in range(50)] + [(99, None)], "i int, segment string")
    literal = matching.literal_matches(segments, [kw.Keyword(o, k.strip(), w) for o, k, w in entries[:60]], ["i"])
    for size in (200, 1 << 20):
        got = matching.match_keywords(segments, table, ["i"], block_bytes=size)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, literal.collect()))
    assert matching.match_keywords(segments, table.where("false"), ["i"]).count() == 0


@pytest.mark.parametrize("lenient", [False, True])
def test_automaton_counts_fifty_thousand_keywords(lenient):
    rng = random.Random(11)
    letters = "aeioulmnrstkzó"
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(60_000)})[:50_000]
    keywords = [*words[:-400], *[f"{a} {b}" for a, b in zip(words[:200], words[200:400])], *[f"{a}, {a}" for a in words[:100]], *[f"{a}+" for a in words[:100]]]
    counter = automaton.Counter([kw.Keyword(i, k) for i, k in enumerate(keywords)], lenient)
    bits = [*rng.sample(words, 150), *words[:40], *kw.SUFFIXES]
    for _ in range(15):
        text = "".join(rng.choice(bits) + rng.choice([" ", " ", ", ", "", "+", "_", "-", "\u0301"]) for _ in range(60))
        text = spec.plain(text) if lenient else text
        count = (lambda k: spec.lenient_count(text, k, kw.SUFFIXES)) if lenient else (lambda k: spec.strict_count(text, k))
        within = [i for i, k in enumerate(keywords) if (spec.plain(k) if lenient else k) in text]
        assert counter.matches(text) == [(i, n) for i in within if (n := count(keywords[i]))]


def test_strip_marks(spark):
    row = frame(spark, ["Żartów ŁÓDŹ ﬁ ½ é"]).select(
        tx.strip_marks(F.col("text")).alias("fast"), tx.strip_marks_exact(F.col("text")).alias("exact")
    ).first()
    assert row.fast.startswith("zartow łodz") and row.exact == spec.plain("Żartów ŁÓDŹ ﬁ ½ é")


def test_shortening(spark):
    rows = ["abc def ghi", "abcdefghijk", "abc de", "ab cdef"]
    got = frame(spark, rows).select(
        "text", tx.truncate_at_word(F.col("text"), 6).alias("cut"), tx.preview(F.col("text"), 6).alias("p")
    ).collect()
    assert [r.cut for r in got] == ["abc", "abcdef", "abc de", "ab"]
    assert [r.p for r in got] == ["abc de...", "abcdef...", "abc de", "ab cde..."]


def test_html_profiles(spark):
    page = "<html><style>x</style><SCRIPT>y</script>a<!-- c --><br>b &amp;lt; &#39;&eacute;</html>"
    row = frame(spark, [page]).select(*[hx.html_to_text(F.col("text"), p).alias(p) for p in "abc"]).first()
    assert row.a == "a b &lt; 'é"
    assert row.b == "a b < '&eacute;"
    assert row.c == "a b < &#39;&eacute;"


def test_html_validity(spark):
    rows = ["x" * 201, "x" * 100, "<p>" + "y" * 60, "<p>Strona: Not Found " + "y" * 60, "<p>supportID " + "y" * 60, ""]
    got = frame(spark, rows).select("i", hx.is_valid_html(F.col("text")).alias("ok")).orderBy("i").collect()
    assert [r.ok for r in got] == [True, False, True, False, False, False]


def test_fields(spark):
    row = spark.range(1).select(
        fields.safe_file_stem(F.lit(" ąb c--d.. ")).alias("stem"),
        fields.safe_member_name(F.lit("Ób c.d")).alias("member"),
        fields.full_name(F.lit(None).cast("string"), F.lit(" Nowak ")).alias("name"),
        fields.duration_seconds(F.lit("2024-01-01T10:00:00"), F.lit("2024-01-01T10:00:59.9")).alias("d"),
        fields.duration_seconds(F.lit("2024-01-01T10:00:00Z"), F.lit("2024-01-01T09:00:00Z")).alias("neg"),
        fields.duration_seconds(F.lit("soon"), F.lit("2024-01-01T09:00:00Z")).alias("bad"),
        fields.media_type(F.lit(fields.PNG_MAGIC + b"x")).alias("png"), fields.media_type(F.lit(b"GIF8")).alias("photo"),
        fields.media_type(F.lit(b"GIF8"), logo=True).alias("logo"),
        F.array_join(fields.validation_errors(F.lit(0), F.lit(201), F.lit("2024-02-30")), ",").alias("errors"),
        fields.success_band(F.lit(50.0), F.lit(3)).alias("band"), fields.success_band(F.lit(0.0), F.lit(0)).alias("none"),
        base.strip(F.lit("  a b\x1c\n")).alias("strip"),
    ).first()
    assert row.asDict() == {
        "stem": "b_c--d..", "member": "_b_c_d", "name": "Nowak", "d": 59, "neg": None, "bad": None, "png": "png",
        "photo": "jpg", "logo": "gif", "errors": "term,proceeding,date_value", "band": "good", "none": None,
        "strip": "a b",
    }
