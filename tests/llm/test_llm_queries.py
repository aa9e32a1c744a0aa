"""The registered queries against SQL or a brute-force version, on whole small tables."""

import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import pytest
from brute_force import brute_classes
from pyspark.sql import functions as F

from rewardloom.llm import queries as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def duck(root):
    con = duckdb.connect()
    for name in os.listdir(root):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{root}/{name}'")
    return con


@pytest.fixture(scope="module")
def documents(spark, root):
    return {r.doc_id: r for r in q.table(spark, root, "documents").collect()}


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_matches_sql(spark, root, duck, name):
    df = q.QUERIES[name](spark, root)
    cursor = duck.execute(q.ORACLES[name])
    columns = sorted(df.columns)
    names = [d[0] for d in cursor.description]
    assert columns == sorted(names)
    want = sorted(str([dict(zip(names, r, strict=True))[c] for c in columns]) for r in cursor.fetchall())
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == want


def test_language_is_learned(spark, root, documents):
    rows = q.op1_language_id(spark, root).collect()
    assert len(rows) == len(documents)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == documents[r.doc_id].lang for r in held) >= 0.95 * len(held)
    sure = [r for r in held if not r.rejected]
    assert sum(r.lang_pred == documents[r.doc_id].lang for r in sure) >= 0.97 * len(sure)


def longest_rule(host, path):
    fits = [r for r in q.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def test_url_rules_and_models(spark, root):
    spam = re.compile("casino|bets|pills|spam|ads-")
    pages = {r.page_id: r.url for r in q.table(spark, root, "pages").collect()}
    rows = q.op3_url_filters(spark, root).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        rest = pages[r.page_id].split("://", 1)[1]
        assert (r.host, r.path) == (re.split("[/?#]", rest)[0], re.match(r"[^/?#]*([^?#]*)", rest)[1])
        rule = longest_rule(r.host, r.path)
        assert r.rule == (rule.name if rule else None)
        if rule:
            assert r.verdict == rule.verdict
    free = [r for r in rows if r.rule is None]
    assert sum((r.verdict == "block") == bool(spam.search(r.host)) for r in free) >= 0.95 * len(free)


def plain_counts(text):
    words = WORD.findall(text)
    triples = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(triples)
    covered = {i + k for i, t in enumerate(triples) if often[t] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_counts_and_rules(spark, root, documents):
    labels = {r.doc_id: r.quality for r in q.table(spark, root, "labels").collect()}
    rows = q.op4_quality_rules(spark, root).collect()
    assert len(rows) == len(documents)
    for r in rows:
        want = plain_counts(documents[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    judged = [r for r in rows if r.doc_id in labels and not r.base_failed]
    assert sum(r.kept == (labels[r.doc_id] == 1) for r in judged) >= 0.95 * len(judged)


def test_rules_hold_on_labels_they_were_not_fitted_on(spark):
    from rewardloom.llm import quality

    root = "/root/testdata/sf0.01"
    docs, labels = q.table(spark, root, "documents"), q.table(spark, root, "labels")
    unseen = labels.filter(F.crc32(F.col("doc_id").cast("string")) % 2 == 0)
    rules = quality.fit_quality_rules(docs, labels.join(unseen, "doc_id", "left_anti"))
    judged = quality.judged_quality(docs, rules).filter("not base_failed").join(unseen, "doc_id")
    right, total = judged.agg(F.count_if(F.col("kept") == (F.col("quality") == 1)), F.count("*")).head()
    assert total > 100 and right >= 0.95 * total


@pytest.mark.parametrize("count", [30, 90, 400])
def test_rules_are_learned_from_few_labels_and_not_from_shuffled_ones(count):
    import numpy as np

    from rewardloom.llm import quality

    rng = np.random.default_rng(count)
    bad = np.arange(count) < max(6, count // 12)
    rows = {f: rng.random(count) for f in quality.FEATURES}
    rows["symbols_per_word"] = np.where(bad, 0.5 + rng.random(count), 0.1 * rng.random(count))
    folds = np.arange(count) % 3
    learned = quality.learn_decision_list(rows, bad, folds)
    assert len(learned.rules) == 1
    assert (quality._met(list(learned.rules[0]), rows, count) == bad).all()
    for _ in range(5):
        assert quality.learn_decision_list(rows, rng.permutation(bad), folds).rules == ()


def test_pieces_agree_with_the_library(spark, root, documents):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=q.piece_model())
    for r in q.op5_sentencepiece(spark, root).collect():
        text = documents[r.doc_id].text
        assert r.ids == library.encode(text) and r.n_tokens == len(r.ids)
        assert r.round_trip and library.decode(r.ids) == text


def test_counts_agree_with_the_tokenizer(spark, root, documents):
    from tokenizers import Tokenizer, models

    from rewardloom.llm.pieces import PieceModel, normalizer_of

    model = PieceModel.parse(q.piece_model())
    plain = Tokenizer(models.Unigram([(p, s) for p, s, _ in model.pieces], 0, True))
    plain.normalizer = normalizer_of(model)
    checked = 0
    for r in q.op6_token_counts(spark, root).collect():
        if "<" not in documents[r.doc_id].text:  # the plain model would take control pieces from the text
            assert r.n_tokens == len(plain.encode(documents[r.doc_id].text, add_special_tokens=False).ids)
            checked += 1
    assert checked > 100


def test_near_duplicates_equal_brute_force(spark, root, documents):
    want = brute_classes({k: r.text for k, r in documents.items()})
    got = {r.doc_id: (r.class_id, r.n_links) for r in q.op7_ngram_jaccard_join(spark, root).collect()}
    assert got == want and sum(n > 0 for _, n in want.values()) > 10


def test_pipeline_equals_its_stages_by_brute_force(spark, root, documents):
    import corpus_pipeline as c

    got = c.run(spark, root)
    assert set(c.COLUMNS) < set(got.columns)
    kept = {r.doc_id for r in q.op4_quality_rules(spark, root).filter("kept").collect()}
    texts = {k: r.text for k, r in documents.items() if k in kept}
    sites, least = {}, {}
    for k in sorted(texts):
        for line in {x.strip(" ") for x in texts[k].split("\n")} - {""}:
            sites.setdefault(line, set()).add(documents[k].source)
            least.setdefault(line, k)
    spread = {line for line, s in sites.items() if len(s) >= 10}
    for k, text in texts.items():
        lines, seen = [], set()
        for raw in text.split("\n"):
            line = raw.strip(" ")
            if line not in spread or (least[line] == k and line not in seen):
                lines.append(raw)
            seen.add(line)
        texts[k] = "\n".join(lines)
    texts = {k: t for k, t in texts.items() if t == documents[k].text or WORD.search(t)}
    texts = {k: texts[k] for k, (label, _) in brute_classes(texts).items() if label == k}
    rows = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    from rewardloom.llm.decontaminate import contamination

    clean = contamination(rows, q.table(spark, root, "benchmark")).filter("not hits.contaminated").collect()
    want = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in clean}
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in got.collect()} == want
    assert 0 < len(want) < len(documents)


def test_line_dedup_stage_keeps_short_remainders(spark, root):
    import corpus_pipeline as c

    shared = "\n".join(f"navigation {i} " + "x" * 90 for i in range(30))
    rows = [(k, f"{shared}\nown text {k}" if k < 11 else shared, "en", f"s{k}", 0) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in c.line_dedup(spark, docs, root).collect()}
    assert got.pop(0) == (rows[0][1], len(rows[0][1]))  # the smallest id keeps the lines
    assert got == {k: (f"own text {k}", len(f"own text {k}")) for k in range(1, 11)}
