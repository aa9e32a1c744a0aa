"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import random

import pytest
from brute_force import brute_classes
from pyspark.sql import functions as F

from rewardloom.llm import (
    chat, components, counts, decontaminate, language, lines, near, pieces, quality, queries, spans, urls, words,
)

MODEL = queries.piece_model()
random.seed(5)
LONG = " ".join(f"w{random.randrange(5000)}" for _ in range(60000))
TEXTS = [None, "", " \t\n", "one", "a b c d", LONG, LONG, "ß é 漢字 word", "x " * 400]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts; ids repeat and one is null, and columns carry names the operators use."""
    rows = [(i if i != 7 else None, t, "en", "s", 1, 2, 3, 4) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(
        [*rows, rows[4]],
        "doc_id long, text string, lang string, source string, hits int, stats int, key int, component int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(
        [(1, "A b, c D"), (1, "A b, c D"), (2, None), (3, ""), (None, "one"), (4, " ".join(LONG.split()[100:120]))],
        "item_id long, text string")


def test_window_hashes_follow_the_words():
    text = words.words_of("a b c a b c d")
    hashes = words.word_hashes(text)
    for seed in (0, 1):
        got = words.window_hashes(hashes, 3, seed)
        assert len(got) == 5 and got[0] == got[3] and len(set(got.tolist())) == 4
    assert len(words.window_hashes(hashes, 8)) == 0
    assert words.words_of(None) == [] and words.words_of("\x1c \x0b") == ["\x1c"]


def test_decontamination_edges(docs, none, benchmark):
    rows = decontaminate.contamination(docs, benchmark, part_words=8).collect()
    whole = decontaminate.contamination(docs, benchmark).collect()
    key = lambda r: (str(r.doc_id), str(r.text)[:20])
    assert sorted((key(r), r.hits) for r in rows) == sorted((key(r), r.hits) for r in whole)
    by = {r.doc_id: r for r in whole if r.doc_id is not None}
    assert by[0].hits.n_words == by[1].hits.n_words == by[2].hits.n_words == 0
    assert by[3].hits["items"] == ["null"] and by[3].hits.contaminated
    assert by[4].hits["items"] == ["1"] and by[4].hits.n_hit == 4
    assert by[5].hits["items"] == ["4"] and by[5].hits.n_hit == 20 and not by[5].hits.contaminated
    span = by[5].hits.spans[0]
    assert LONG[span.start:span.end] == " ".join(LONG.split()[100:120])
    assert len(rows) == docs.count() and whole[0]["key"] == 3
    assert decontaminate.contamination(none, benchmark).count() == 0
    assert decontaminate.contamination(docs, benchmark.limit(0)).filter("hits.contaminated").count() == 0


def test_automaton_finds_all_windows():
    import numpy as np

    def brute(items, text, window):
        hit, found = np.zeros(len(text), bool), set()
        for name, item in items:
            size = min(window, len(item))
            windows = {tuple(item[i:i + size]) for i in range(len(item) - size + 1)} if item else ()
            for i in range(len(text) - size + 1):
                if tuple(text[i:i + size]) in windows:
                    hit[i:i + size] = True
                    found.add(name)
        return hit, found

    for seed in range(150):
        draw = random.Random(seed)
        window, most = draw.choice([1, 2, 4, 5, 13]), draw.choice([13, 20, 1 << 16])
        word = lambda n: [b"w%d" % draw.randrange(n) for _ in range(draw.randrange(40))]
        kinds = draw.choice([2, 8, 50])
        items = [(str(k), word(kinds)) for k in range(draw.randrange(8))]
        pieces_of = [(p, [n]) for n, w in items for p in decontaminate.item_pieces(b" ".join(w).decode(), window, most)]
        automaton = decontaminate.Automaton([p for p, _ in pieces_of], [n for _, n in pieces_of], window)
        for _ in range(4):
            text = word(kinds + 2)
            for _, item in items:
                a = draw.randrange(len(item) + 1)
                text += item[a:a + draw.randrange(30)] + word(kinds + 2)[:3]
            hit, found = np.zeros(len(text), bool), set()
            automaton.mark(text, hit, found)
            want = brute(items, text, window)
            assert (hit == want[0]).all() and found == want[1]


def test_a_large_benchmark_is_one_pass(spark, docs):
    frame = spark.range(4000).select(
        F.col("id").alias("item_id"),
        F.array_join(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lit("q"), F.xxhash64("id", i))), " ").alias("text"))
    frame = frame.union(spark.createDataFrame([(9000, " ".join(LONG.split()[500:540]))], "item_id long, text string"))
    judged = decontaminate.contamination(docs, frame)
    assert judged._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert [r.hits["items"] for r in judged.filter("doc_id = 5").collect()] == [["9000"]]


def test_spans_equal_brute_force(spark, docs, none):
    got = spans.remove_repeated_spans(docs).select("doc_id", "text", "spans").collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r.spans for r in got if r.text == LONG}
    assert by[5].n_removed == 0 and by[6].n_removed == 60000 and by[6].text == ""
    assert spans.remove_repeated_spans(none).count() == 0
    base = [f"b{i}" for i in range(300)]
    rows = []
    for k in range(30):  # passages of other lengths and offsets, with edits, inside own words
        a = random.randrange(200)
        part = base[a:a + random.randrange(20, 100)]
        if k % 3 == 0 and len(part) > 60:
            part[55] = "edit"
        rows.append((k // 2 * 2 if k == 3 else k, " ".join([f"o{k}"] * 3 + part + [f"p{k}"] * 4)))
    want = {}
    seen = {}
    for k, text in rows:
        w = text.split()
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i:i + 50]), []).append(k)
    for k, text in rows:
        w = text.split()
        gone = {i + j for i in range(len(w) - 49) if min(seen[tuple(w[i:i + 50])]) < k for j in range(50)}
        want[k, text] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.text): tuple(r.spans) for r in spans.remove_repeated_spans(frame).collect()} == want
    assert any(v[1] for v in want.values())


def test_near_duplicates_in_small_buckets_and_blocks(spark, none):
    random.seed(11)
    base = [f"v{random.randrange(900)}" for _ in range(120)]
    rows = []
    for k in range(60):  # one large group of near copies, with copies among them
        text = list(base)
        for _ in range(k % 5):
            text[random.randrange(120)] = f"n{k}"
        rows.append((k, " ".join(text)))
    rows += [(100 + k, " ".join(f"u{k}_{i}" for i in range(30))) for k in range(20)]
    rows += [(200, None), (201, ""), (202, "a b"), (203, "a b"), (204, "a c"), (205, " a  b ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(dict(rows))
    for options in ({}, {"bucket_rows": 4, "block_shingles": 500, "deepest": 3}):
        got = near.near_duplicates(frame, **options).collect()
        assert {r.doc_id: (r.class_id, r.n_links) for r in got} == want
    assert want[203] == (202, 2) and want[200] == (200, 0)
    twice = near.near_duplicates(frame.union(frame.filter("doc_id = 202"))).filter("doc_id = 202").collect()
    assert [(r.class_id, r.n_links) for r in twice] == [(202, 3)] * 2
    assert near.near_duplicates(none).count() == 0
    null_key = near.near_duplicates(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string"))
    assert [tuple(r) for r in null_key.orderBy("n_links").collect()] == [(None, None, 0)] * 2


def test_null_and_repeated_keys_link(spark):
    base = [f"v{i}" for i in range(60)]
    edited = lambda n: " ".join([*base[:-1], f"e{n}"])
    rows = [(1, " ".join(base)), (None, edited(1)), (None, edited(1)), (None, "other " * 9), (2, "far away"),
            *[(3, " ".join(f"z{k}_{i}" for i in range(30))) for k in range(20)], (3, edited(2))]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    count = lambda k: sorted((r.class_id, r.n_links) for r in got if r.doc_id == k)
    assert count(1) == [(1, 3)] and count(2) == [(2, 0)]
    assert count(3) == [(1, 3)] + [(3, 0)] * 20
    assert sorted(r.n_links for r in got if r.doc_id is None) == [0, 3, 3]


def test_sets_on_one_template_are_not_compared(spark):
    draw = random.Random(4)
    template = [f"t{i}" for i in range(100)]
    rows = []
    for k in range(600):  # three fifths of the words shared: a similarity of about 0.43
        if k % 50 == 1:
            rows.append((k, rows[-1][1] + " more"))  # a near copy of the one before
        else:
            rows.append((k, " ".join(template + [f"o{k}_{i}" for i in range(draw.randrange(60, 70))])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = {k: (k - 1, 1) if k % 50 == 1 else (k, int(k % 50 == 0)) for k, _ in rows}
    got = near.near_duplicates(frame, bucket_rows=64).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == want
    sets = frame.select(F.col("doc_id").alias("id"), near._sketched(5)("text").alias("s")).select("id", "s.sketch")
    edges, unsure = near._candidate_edges(sets, 0.8, 0.999, 64, 8)
    whole = components.connected_components(edges).withColumnRenamed("label", "component")
    sizes = near._refined(whole, unsure, sets, 0.8, 64).groupBy("component").count()
    assert sizes.agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).head()[0] <= 60  # pairs compared exactly


def test_shared_counts_and_runs():
    import numpy as np

    sets = [np.unique(np.random.default_rng(i).integers(0, 60, 40)).astype(np.uint64) for i in range(6)]
    got = near.shared_counts(sets)
    for i in range(6):
        for j in range(6):
            if i != j:
                assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))
    assert near.runs_for(0.999, 0.8, 3) == 15


def test_runs_follow_the_depth():
    assert near.first_runs(0.999, 0.8) == 16 and near.more_runs(0.999, 0.8, 16, 3) == 0
    assert [near.more_runs(0.999, 0.8, 16, d) for d in (4, 6, 8)] == [7, 18, 31]
    for depth in range(1, 9):
        more = near.more_runs(0.999, 0.8, 16, depth)
        assert near.lost_share(0.8, depth, 16, more) <= 0.001


def test_recall_holds_where_buckets_are_split_deep(spark):
    import numpy as np

    draw = np.random.default_rng(9)
    first = draw.integers(0, 2, (300, near.COORDINATES))  # every value is that of half the rows, so buckets halve slowly
    other = np.where(draw.random(first.shape) < 0.05, 2 + np.arange(300)[:, None], first)
    rows = np.stack([first, other], axis=1).reshape(600, -1).astype(np.uint32)
    frame = spark.createDataFrame([(i, bytearray(r.tobytes())) for i, r in enumerate(rows)], "id long, sketch binary")
    edges, _ = near._candidate_edges(frame, 0.95, 0.999, 2, 8)
    label = {r.id: r.label for r in components.connected_components(edges).collect()}
    assert len(set(label.values())) > 250  # the pairs are not connected through others
    found = sum(2 * i in label and label[2 * i] == label.get(2 * i + 1) for i in range(300))
    assert found >= 299


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.id: r.label for r in components.connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components.connected_components(edges.limit(0)).count() == 0


def test_line_dedup_edges(spark, none):
    rows = [(k, f"s{k % 12}", f"own {k}\n  shared \n\nshared\nnear") for k in range(12)]
    rows += [(20, None, "shared"), (21, "s1", None), (22, "s1", ""), (None, "s2", "shared\nx"), (5, "s5", "shared\nmore")]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("lines", F.lit(0))
    frame = frame.withColumn("text", F.when(F.col("doc_id") < 2, F.replace("text", F.lit("near"), F.lit("far"))).otherwise(F.col("text")))
    got = {(r.doc_id, r.source): r.lines for r in lines.without_boilerplate(frame, sites=11).collect() if r.doc_id != 5}
    assert got[0, "s0"].text == "own 0\n  shared \n\nfar" and got[0, "s0"].n_removed == 1
    assert got[3, "s3"].text == "own 3\n\nnear"  # "near" is on ten sites only
    assert got[20, None].text == "" and got[21, "s1"].text is None and got[22, "s1"].text == ""
    assert got[None, "s2"].text == "shared\nx"
    more = lines.without_boilerplate(frame, sites=11).filter("doc_id = 5").collect()
    assert sorted(r.lines.text for r in more) == ["more", "own 5\n\nnear"]
    assert lines.without_boilerplate(none).count() == 0


def test_quality_edges(spark, docs, none):
    judged = quality.judged_quality(docs, quality.DecisionList(())).collect()
    assert len(judged) == docs.count()
    by = {r.doc_id: r for r in judged if r.doc_id is not None}
    assert by[0].base_failed and by[1].base_failed and not by[0].kept and by[5].kept
    assert by[8].base_failed and by[8].stats.n_repeat_words == 400
    labels = spark.createDataFrame([(5, 1), (8, 0), (8, 0), (0, None), (1, 0), (1, 1)], "doc_id long, quality int")
    assert quality.fit_quality_rules(docs, labels.limit(0)).rules == ()
    assert quality.fit_quality_rules(none, labels).rules == ()
    assert isinstance(quality.fit_quality_rules(docs, labels), quality.DecisionList)
    assert quality.judged_quality(none, quality.DecisionList(())).count() == 0
    counts_of = dict(zip(quality.COUNTS, quality.text_counts("A a\n#x!\nA a\n\nb"), strict=True))
    assert (counts_of["n_dup_lines"], counts_of["n_lines"], counts_of["n_upper"], counts_of["n_marks"]) == (1, 4, 2, 1)


def test_decision_list_is_learned_and_pruned():
    import numpy as np

    draw = np.random.default_rng(3)
    rows = {"a": draw.random(900), "b": draw.random(900), "noise": draw.random(900)}
    bad = (rows["a"] > 0.8) | ((rows["b"] < 0.2) & (rows["a"] > 0.4))
    rules = quality.learn_decision_list(rows, bad, np.arange(900) % 3)
    met = np.any([np.logical_and.reduce([c.holds(rows) for c in r]) for r in rules.rules], axis=0)
    assert (met == bad).mean() > 0.97 and 2 <= len(rules.rules) <= 6
    assert all("noise" not in text for text in rules.describe())


def test_language_edges(docs, none):
    model = language.fit_languages(docs.withColumn("lang", F.when(F.col("doc_id") > 4, "en").when(F.col("doc_id") > 2, "fr")))
    got = {r.doc_id: r.language for r in language.identified(docs, model).collect()}
    assert got[0].lang == got[1].lang == got[2].lang == "und" and got[0].score == 0
    assert got[5].lang in ("en", "fr") and 0 <= got[5].score <= 1
    empty = language.fit_languages(none)
    assert empty.languages == ()
    assert {r.language.lang for r in language.identified(docs, empty).collect()} == {"und"}
    assert language.identified(none, model).count() == 0
    assert not language.has_letter("12 _ 3") and language.has_letter("漢")


def test_url_edges(spark):
    rows = [(1, None), (2, ""), (3, "no scheme.org/x"), (4, "HTTP://WWW.A.ORG"), (5, "x://a.org/B?c://d"), (6, "x://b.com#/fr/"),
            (7, "x://example.org/en/12"), (7, "x://example.org/en/12"), (8, "://"), (9, "x://" + "é" * 5000 + ".net/漢")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("host", F.lit(2))
    models = urls.fit_url_models(pages.withColumn("good", F.col("page_id") % 2 == 0))
    got = {r.page_id: r for r in urls.judged_urls(pages, queries.URL_RULES, models).collect()}
    assert [(got[k].host, got[k].path) for k in (1, 2, 3, 4, 5, 6, 8)] == [
        ("", ""), ("", ""), ("", ""), ("www.a.org", ""), ("a.org", "/B"), ("b.com", ""), ("", "")]
    assert got[1].verdict == got[2].verdict == "block" and got[4].rule is None
    assert (got[5].rule, got[5].verdict) == ("org/", "allow")
    assert (got[7].rule, got[7].verdict) == ("example.org/en/1", "block")
    assert all(r.verdict in ("allow", "block") for r in got.values())
    nothing = urls.fit_url_models(pages.limit(0).withColumn("good", F.lit(True)))
    judged = urls.judged_urls(pages, queries.URL_RULES, nothing).filter("rule is null").collect()
    assert {r.verdict for r in judged if r.url} == {"allow"}
    assert urls.judged_urls(pages.limit(0), queries.URL_RULES, models).count() == 0


def test_pieces_and_counts_edges(docs, none):
    done = pieces.encoded(docs, MODEL, check_parity=True).collect()
    assert all(r.pieces is None if r.text is None else r.pieces.parity and r.pieces.round_trip for r in done)
    assert next(r for r in done if r.doc_id == 1).pieces.ids == []
    again = pieces.decoded(pieces.encoded(docs, MODEL).select("doc_id", F.col("text").alias("was"), "pieces.ids"), MODEL, "ids")
    assert all(r.text == r.was for r in again.collect())
    counted = {r.doc_id: r.n_tokens for r in counts.token_counts(docs, MODEL).collect()}
    assert counted[0] is None and counted[1] == 0 and counted[5] > 60000
    assert pieces.encoded(none, MODEL).count() == counts.token_counts(none, MODEL).count() == 0
    assert pieces.parity_failures(MODEL, pieces.PROBES) == []


def test_counting_without_cuts_and_without_bytes():
    from dataclasses import replace

    model = pieces.PieceModel.parse(MODEL)
    whole, apart = counts.PieceCounter(model), counts.PieceCounter(model)
    whole.apart = False
    for text in TEXTS[1:5] + TEXTS[7:]:
        assert whole.count(text) == apart.count(text)
    plain = counts.PieceCounter(replace(model, byte_fallback=False))
    assert plain.count("a\U00012000\U00012001 b") == plain.count("a\U00012000 b")  # unknown characters in a row are one piece


def test_chat_edges(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes <|im_end|>"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "yes <|im_end|>"), (2, 2, "user", "more"),
        (3, 5, "user", "hi"), (3, 9, "assistant", "no"), (3, 9, "assistant", "no"),
        (4, 0, "user", "hi"), (4, 1, "assistant", "no"), (5, 0, None, None), (None, 0, "user", ""), (6, None, "user", "x"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(1))
    got = {r.conv_id: r for r in chat.format_conversations(frame).collect()}
    assert sorted(got, key=str) == [2, 3, 5, 6, None]
    assert got[2].n_turns == 3 and "yes < |im_end|>" in got[2].text
    assert got[3].n_copies == 2 and got[3].n_turns == 2
    assert got[5].text == "<|im_start|>unknown\n<|im_end|>\n"
    assert chat.format_conversations(frame.limit(0)).count() == 0


def test_columns_may_carry_any_internal_name(spark):
    names = ["mark_key", "marks", "run_key", "run_content", "run_list", "_rule", "line", "key", "content", "least"]
    rows = [(k, f"shared line\nown {k} " + " ".join(f"w{i}" for i in range(60)), f"s{k}", "http://a.org/x", *range(10)) for k in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, url string, " + ", ".join(f"{n} int" for n in names))
    models = urls.fit_url_models(spark.createDataFrame([("http://a.org/x", True), ("http://b.com/y", False)], "url string, good boolean"))
    for done in (lines.without_boilerplate(frame), spans.remove_repeated_spans(frame), urls.judged_urls(frame, queries.URL_RULES, models)):
        got = done.select("doc_id", *names).collect()
        assert sorted(r.doc_id for r in got) == list(range(12)) and all(tuple(r)[1:] == tuple(range(10)) for r in got)
    cut = lines.without_boilerplate(frame).select("doc_id", "lines.n_removed").collect()
    assert {r.doc_id: r.n_removed for r in cut} == {k: int(k > 0) for k in range(12)}
    gone = spans.remove_repeated_spans(frame).select("doc_id", "spans.n_removed").collect()
    assert {r.doc_id: r.n_removed for r in gone} == {k: 60 * (k > 0) for k in range(12)}


def test_numbers_are_no_letters():
    assert not any(map(language.has_letter, ["²", "Ⅷ ½", "12 _", "", None]))
    assert language.has_letter("² a") and language.has_letter("漢")
