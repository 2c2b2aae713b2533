"""The operators on documents, next to brute force and on odd input."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rollcall.llm import (
    language_mixture,
    license_scan,
    near_dedup,
    packing,
    quality_kn,
    records,
    setsketch,
    source_mix,
    substring_dedup,
)
from rollcall.llm.text import ascii_words, chained, mixed, shingle_set, word_hashes
from rollcall.session import scratch_path

WORDS_49K = public_tokenizers.path("word_bpe_49k.json")
BYTES_50K = public_tokenizers.path("byte_bpe_50k.json")


# --- 1 quality ---------------------------------------------------------------------------


def test_quality_rejects_symbols_and_keeps_prose(spark, prose):
    junk = ["".join(random.Random(k).choices("#$%&*@~^", k=400)) for k in range(20)]
    rows = [(k, prose(80, k), "en") for k in range(200)] + [(1000 + k, x, "en") for k, x in enumerate(junk)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(100)] + [(1000, 0)], "doc_id long, quality int")
    judged = {r.doc_id: r for r in quality_kn.quality_model(docs, labels).judged().collect()}
    assert all(judged[k].accepted for k in range(200)) and not any(judged[k].accepted for k in range(1000, 1020))


def test_kneser_ney_sums_to_one(spark, prose):
    table = quality_kn.train(spark.createDataFrame([(prose(500, 9),)], "text string"))
    sums = (2.0 ** table.astype(float)).reshape(-1, quality_kn.SYMBOLS).sum(axis=1)
    assert np.abs(sums - 1).max() < 1e-3


def test_quality_grows_with_the_vocabulary_and_sees_salad(spark):
    draw = random.Random(8)
    letters = [chr(c) for c in range(0x430, 0x450)]
    lexicon = ["".join(draw.choices(letters, k=draw.randint(4, 9))) for _ in range(400)]
    after = {w: draw.sample(lexicon, 3) for w in lexicon}  # three words may follow each

    def prose_of(n):
        out = [draw.choice(lexicon)]
        while len(out) < n:
            out.append(draw.choice(after[out[-1]]))
        return " ".join(out)

    rows = [(k, prose_of(150)) for k in range(300)]
    rows += [(1000 + k, " ".join(draw.choices(lexicon, k=150))) for k in range(20)]
    rows += [(2000 + k, " ".join("".join(draw.choices(letters, k=6)) for _ in range(150))) for k in range(20)]
    docs = spark.createDataFrame([(*r, "ru") for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(200)], "doc_id long, quality int")
    model = quality_kn.quality_model(docs, labels)
    accepted = {r.doc_id: r.accepted for r in model.judged().collect()}
    assert sum(accepted[k] for k in range(300)) >= 295
    assert not any(accepted[k] for k in accepted if k >= 1000)
    assert model.model.words.count() > 2 * 1600  # words, pairs and triples of both halves, without a limit


def test_quality_odd(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (6, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    model = quality_kn.quality_model(odd_docs, labels)
    judged = model.judged()
    assert judged.count() == odd_docs.count()
    assert {r.doc_id for r in judged.where("perplexity is null").collect()} == {3, 4}
    assert model.judge(odd_docs).columns[: len(odd_docs.columns)] == odd_docs.columns
    assert quality_kn.quality_model(no_docs, labels).judged().count() == 0
    assert quality_kn.quality_model(odd_docs, labels.limit(0)).judged().where("accepted").count() == odd_docs.count() - 2


# --- 2 near copies -----------------------------------------------------------------------


def brute_components(rows, percent):
    sets = {}
    for doc, text in rows:
        w = ascii_words(text)
        sets.setdefault(doc, []).append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    flat = [(d, s) for d, all_ in sets.items() for s in all_ if s]
    for i, (a, x) in enumerate(flat):
        for b, y in flat[:i]:
            if 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {d: top(d) for d in sets}


def test_near_copies_equal_brute_force(spark, prose):
    rows, draw = [], random.Random(3)
    for k in range(12):
        words = prose(90, k).split()
        for _ in range(8):
            own = list(words)
            for _ in range(draw.randint(0, 5)):
                own[draw.randrange(len(own))] = f"x{draw.random()}"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows), rows[0][1].upper()), (len(rows) + 1, "a b"), (len(rows) + 2, "A  b")]
    got = near_dedup.link_documents(spark.createDataFrame(rows, "doc_id long, text string"), cell=4).collect()
    want = brute_components(rows, 85)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert {r.doc_id: r.n_shingles for r in got} == {d: len(shingle_set(ascii_words(t))) for d, t in rows}


def test_near_copies_odd(odd_docs, no_docs):
    got = near_dedup.link_documents(odd_docs).collect()
    assert len(got) == odd_docs.count()
    of = {r.doc_id: r for r in got}
    assert of[2].component_id == 1 and not of[2].kept
    assert all(of[k].n_shingles == 0 and of[k].kept for k in (3, 4, 5))
    assert near_dedup.keep_first(odd_docs).where("doc_id = 2").count() == 0
    assert near_dedup.link_documents(no_docs).count() == 0


def test_sketches_merge_and_estimate():
    sketch = setsketch.SetSketch(256)
    draw = np.random.default_rng(1)
    x = draw.integers(0, 1 << 63, 1000, np.uint64)
    a, b = x[:900], x[100:]
    ra, rb = sketch.registers(a), sketch.registers(b)
    assert (setsketch.merged(ra, rb) == sketch.registers(x)).all()
    args = (ra[None], rb[None], np.array([900]), np.array([900]))
    assert setsketch.plausible(*args, 0.8, 4.0)[0]  # they share 800 of 1,000
    assert not setsketch.plausible(*args, 0.97, 4.0)[0]


# --- 3 passages --------------------------------------------------------------------------


def test_passages_are_cut_once(spark, prose):
    passage = prose(70, 77)
    texts = [f"{prose(60, k)} {passage} {prose(40, 100 + k)}\nlast line" for k in range(6)] + [prose(150, k) for k in range(200, 206)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.drop_repeats(docs).collect()}
    assert got[0].text == texts[0] and all(got[k].text == texts[k] for k in range(6, 12))
    for k in range(1, 6):
        assert passage not in got[k].text and got[k].removed_words == 70
        assert got[k].text == texts[k].replace(passage + " ", "")


def test_near_copies_of_passages_go(spark, prose):
    rows = []
    for k in range(12):
        words = prose(180, 500 + k).split()
        edited = list(words)
        edited[90] = "changed"
        if k % 2:
            edited[45:45], edited[140:141] = ["put", "in"], []
        rows += [(2 * k, f"{prose(30, 700 + k)} {' '.join(words)}"), (2 * k + 1, f"{' '.join(edited)} {prose(30, 800 + k)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.removed_words for r in substring_dedup.drop_repeats(docs).collect()}
    assert all(got[2 * k] == 0 for k in range(12))
    assert all(got[2 * k + 1] == (181 if k % 2 else 180) for k in range(12))


def test_similar_passages_of_a_pair():
    a = [b"w%d" % k for k in range(90)]
    b = [b"x", *a[:44], b"y", *a[45:], b"z"]
    assert substring_dedup.shared_spans(a, b, [(5, 6)], 16, 5, 0.8) == [(0, 90)]
    far = [w if k % 6 else b"e%d" % k for k, w in enumerate(a)]  # an edit every six words is no copy
    far[5:21] = a[5:21]
    (low, high), = substring_dedup.shared_spans(a, far, [(5, 5)], 16, 5, 0.8)
    assert high - low < 50


def test_near_passages_are_found_over_edits_of_any_size():
    """Passages of Jaccard 0.8 to 0.95 in unlike texts, from their band keys on."""
    make = substring_dedup.Paragraphs(16, 36, 5, substring_dedup.tune_bands(0.8, 0.95), 2)
    shingles = lambda x: {tuple(x[i : i + 5]) for i in range(len(x) - 4)}
    found, asked = 0, 0
    for trial in range(300):
        draw = random.Random(trial)
        some = lambda n: [b"w%d" % draw.randrange(5000) for _ in range(n)]
        passage = some(draw.randint(90, 240))
        edited, cut = list(passage), draw.randrange(20, len(passage) - 20)
        if trial % 2:
            edited[cut:cut] = some(1 + trial % 15)
        else:
            for k in range(cut, len(edited) - 5, 60):
                edited[k] = b"edit%d" % k
        x, y = shingles(passage), shingles(edited)
        if not 0.8 <= len(x & y) / len(x | y) <= 0.95:
            continue
        asked += 1
        a, b = some(100) + edited + some(80), some(60) + passage + some(90)
        (ats, keys), (others, other_keys) = (make.keys(b" ".join(t).decode()) for t in (a, b))
        first = {}
        for at, row in zip(others, other_keys, strict=True):
            for key in row:
                first.setdefault(key, int(at))
        places = {(int(at), first[key]) for at, row in zip(ats, keys, strict=True) for key in row if key in first}
        spans = substring_dedup.shared_spans(a, b, list(places), 16, 5, 0.8)
        end = 100 + len(edited)
        found += any(low <= 102 and end - 2 <= high and 98 <= low and high <= end + 2 for low, high in spans)
    assert asked > 150 and found >= 0.97 * asked


def test_regions_of_texts_that_repeat_themselves():
    few = [b"w%d" % random.Random(k).randrange(4) for k in range(1500)]
    assert substring_dedup.shared_spans(few, few, [(0, 0), (40, 40)], 16, 5, 0.8) == [(0, 1500)]
    same = [b"a"] * 900
    assert substring_dedup.shared_spans(same, same[:300], [(0, 0)], 16, 5, 0.8)[0][0] == 0
    assert substring_dedup.shared_spans([b"a"] * 3, same, [], 16, 5, 0.8) == []


def test_passages_behind_a_common_line(spark, prose):
    line = prose(40, 900)
    rows = [(0, f"{prose(60, 901)} {line} {prose(60, 902)}")]
    for k in range(8):
        own = f"{prose(10, 910 + k)} {line} {prose(10, 930 + k)}"
        rows += [(n, f"{prose(40, 950 + n)} {own} {prose(40, 990 + n)}") for n in (2 * k + 1, 2 * k + 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.removed_words for r in substring_dedup.drop_repeats(docs).collect()}
    assert all(got[n] == (60 if n and n % 2 == 0 else 0) for n in got)


def test_near_copies_of_short_passages_hold_a_paragraph():
    """Any passage of 50 words with one edit has 24 words in a row, and those a whole paragraph."""
    run = substring_dedup.least_run(50, 5, 0.8)
    assert run == 24 and substring_dedup.least_run(50, 5, 1.0) == 50
    make = substring_dedup.Paragraphs(16, run - 15, 5, 1, 2)
    for trial in range(200):
        draw = random.Random(trial)
        some = lambda n: [b"w%d" % draw.randrange(5000) for _ in range(n)]
        common = some(run)
        a, b = some(draw.randrange(80)) + common + some(60), some(draw.randrange(80)) + common + some(60)
        (ats, keys), (others, other_keys) = (make.keys(b" ".join(x).decode()) for x in (a, b))
        places = {tuple(a[at : at + 16]) for at in ats} & {tuple(b[at : at + 16]) for at in others}
        assert places and set(keys.ravel()) & set(other_keys.ravel())


def test_short_near_copies_go(spark, prose):
    rows = []
    for k in range(40):
        words = prose(50, 2000 + k).split()
        rows.append((2 * k, f"{prose(30, 2100 + k)} {' '.join(words)} {prose(30, 2200 + k)}"))
        words[25] = "changed"
        rows.append((2 * k + 1, f"{prose(20, 2300 + k)} {' '.join(words)} {prose(40, 2400 + k)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.removed_words for r in substring_dedup.drop_repeats(docs).collect()}
    assert all(got[2 * k] == 0 and got[2 * k + 1] >= 50 for k in range(40))


def test_near_copies_behind_a_common_line(spark, prose):
    """The first document has the line that all paragraphs of a near copy stand in, and no more."""
    line = prose(40, 3000)
    rows = [(0, f"{prose(60, 3001)} {line} {prose(60, 3002)}")]
    for n, tail in ((1, "put"), (2, "in")):
        rows.append((n, f"{prose(40, 3003 + n)} {line} {tail} {prose(14, 3010)} {prose(50, 3020 + n)}"))
    # Places of the first document beyond its first one count, too.
    twice = prose(20, 3030)
    rows.append((10, f"{twice} {prose(60, 3031)} {twice} {prose(20, 3032)} changed {prose(25, 3033)} {prose(30, 3034)}"))
    rows.append((11, f"{prose(60, 3035)} {twice} {prose(20, 3032)} other {prose(25, 3033)} {prose(30, 3036)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.removed_words for r in substring_dedup.drop_repeats(docs).collect()}
    assert got[0] == got[1] == got[10] == 0 and got[2] >= 55 and got[11] >= 66


def test_near_copies_behind_a_line_of_many_documents(spark, prose):
    """More documents have the line than are taken as leaders, and the only near copy is none of theirs."""
    line = prose(35, 3100)
    rows = [(n, f"{prose(60, 3110 + n)} {line} {prose(60, 3130 + n)}") for n in range(8)]
    for n, tail in ((8, "put"), (9, "in")):
        rows.append((n, f"{prose(40, 3150 + n)} {line} {tail} {prose(14, 3160)} {prose(50, 3170 + n)}"))
    # The same in front of the line.
    other = prose(35, 3200)
    rows += [(20 + n, f"{prose(60, 3210 + n)} {other} {prose(60, 3230 + n)}") for n in range(8)]
    for n, head in ((28, "put"), (29, "in")):
        rows.append((n, f"{prose(40, 3250 + n)} {prose(14, 3260)} {head} {other} {prose(50, 3270 + n)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.removed_words for r in substring_dedup.drop_repeats(docs).collect()}
    assert got.pop(9) == got.pop(29) == 50 and not any(got.values())


def test_runs_beside_a_gap_make_up_for_it():
    steps = substring_dedup.beside_gap(16, 9, 5, 0.8)
    for long in range(24, 80):
        for short in range(5, long + 1):
            for gap in range(1, 15):
                common = long + short - 8
                if common >= 0.8 * (common + gap + 8):  # a paragraph ends at most 8 words before the gap
                    assert any(long - 24 >= more and short >= size for more, size in steps)


def test_near_copies_of_a_middle_place(spark, prose):
    """The smallest document has the line three times, and the near copy is around the second."""
    line, tail = prose(35, 3300), prose(14, 3301)
    rows = [(0, f"{prose(60, 3302)} {line} {prose(60, 3303)} {line} put {tail} {prose(60, 3304)} {line} {prose(60, 3305)}")]
    rows.append((1, f"{prose(40, 3306)} {line} in {tail} {prose(50, 3307)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.removed_words for r in substring_dedup.drop_repeats(docs).collect()}
    assert got == {0: 0, 1: 50}


def test_passages_odd(odd_docs, no_docs):
    got = substring_dedup.drop_repeats(odd_docs)
    assert got.count() == odd_docs.count() and got.columns.count("removed_words") == 1
    assert got.where("doc_id = 2").first().removed_words == 120
    assert got.where("doc_id = 1 and removed_words = 0").count() == 2
    assert substring_dedup.drop_repeats(no_docs).count() == 0


# --- 4 language --------------------------------------------------------------------------


def test_languages_of_a_mixture(spark):
    draw = random.Random(5)
    word = lambda letters: "".join(draw.choices(letters, k=6))
    text = lambda letters: " ".join(word(letters) for _ in range(60))
    learn = [(lang, text(letters)) for lang, letters in (("x", "abcde"), ("y", "mnopq"), ("z", "tuvwy")) for _ in range(20)]
    learn = spark.createDataFrame([*learn, (None, "abc"), ("x", None)], "lang string, text string")
    asked = spark.createDataFrame([(1, text("abcde")), (2, f"{text('mnopq')} {text('mnopq')} {text('tuvwy')}"), (3, "12 - 7"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in language_mixture.identify(asked, learn).collect()}
    assert got[1].lang_pred == "x" and got[1].score > 0.95
    assert got[2].lang_pred == "y" and {m.lang for m in got[2].languages} == {"y", "z"} and abs(got[2].score - 2 / 3) < 0.05
    assert (got[3].lang_pred, got[3].score, got[4].lang_pred) == ("und", 0.0, "und")


def test_language_odd(odd_docs, no_docs):
    got = language_mixture.identify(odd_docs, odd_docs)
    assert got.count() == odd_docs.count() and got.where("score < 0 or score > 1").count() == 0
    assert {r.doc_id for r in got.where("lang_pred = 'und'").collect()} == {3, 4, 5}
    assert language_mixture.identify(odd_docs, no_docs).where("lang_pred <> 'und'").count() == 0
    assert language_mixture.identify(no_docs, odd_docs).count() == 0


# --- 5 mixing ----------------------------------------------------------------------------


def test_shortages_go_to_siblings_first(spark):
    # Language en of domain a is short: de of domain a takes what it leaves, domain b its own share.
    rows = [(k, "w " * 9, "a", "en") for k in range(10)] + [(100 + k, "w " * 9, "a", "de") for k in range(100)]
    rows += [(1000 + k, "w " * 9, "b", "en") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, d string, lang string")
    levels = {"d": F.col("d"), "lang": F.col("lang")}
    got = source_mix.mix(docs, levels, {"lang": {"en": 9.0, "de": 1.0}}, share=0.5, epochs=1)
    tokens = {(r.d, r.lang): r.n for r in got.groupBy("d", "lang").agg((F.count(F.lit(1)) * 10).alias("n")).collect()}
    assert tokens[("a", "en")] == 100 and 415 < tokens[("a", "de")] <= 425 and 515 < tokens[("b", "en")] <= 525


def test_epochs_hold_each_document_once(spark):
    docs = spark.createDataFrame([(k, "w " * 4, "s") for k in range(50)], "doc_id long, text string, s string")
    got = source_mix.mix(docs, {"s": F.col("s")}, {}, share=1.5, epochs=2).collect()
    times = Counter(r.doc_id for r in got)
    assert len(got) == 75 and set(times.values()) == {1, 2} and len({(r.doc_id, r.epoch) for r in got}) == 75


def test_mix_odd(odd_docs, no_docs):
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    everything = source_mix.mix(odd_docs, levels, {}, share=1.0, epochs=1)
    assert everything.count() == odd_docs.count() and everything.columns == [*odd_docs.columns, "epoch"]
    assert source_mix.mix(odd_docs, levels, {"lang": {"en": 0.0}}, epochs=1).where("lang = 'en'").count() == 0
    assert source_mix.mix(no_docs, levels, {}).count() == 0


# --- 7 licenses --------------------------------------------------------------------------


def brute_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    out = []
    for phrase, label in license_scan.PHRASES.items():
        own = phrase.split()
        out += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    return len(words), sorted(out)


def test_license_places_equal_brute_force(spark, odd_docs, prose):
    texts = [
        "Under the MIT-License; MIT\n LICENSE. the mit licenses", "GNU General  Public License, apache_license", None, "", "mit",
        "general public general public license", "É mit license É", prose(40, 1) + " apache license",
        "Mit License " * 500,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in license_scan.license_labels(docs.unionByName(docs.where("doc_id = 0"))).collect():
        n, places = brute_places(texts[r.doc_id])
        assert (r.n_words, r.n_base) == (n, len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
    assert license_scan.license_labels(odd_docs).count() == odd_docs.count()


def test_license_notice_with_gaps(spark):
    words = license_scan.NOTICES["bsd"].split()
    text = "x y " + " ".join([*words[:8], "really", *words[8:14], *words[16:]]) + " z"
    row = license_scan.license_labels(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.labels == "bsd" and row.base_labels == "" and 0.6 < row.score < 1
    span = license_scan.spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"]).first()
    assert (span.first_word, span.last_word) == (2, len(text.split()) - 2)


def test_license_needs_places_in_order(spark, prose):
    mpl, bsd = license_scan.NOTICES["mpl"].split(), license_scan.NOTICES["bsd"].split()
    texts = {
        1: "this agreement is subject to the terms of the laws of the state",
        2: "is subject to the terms of the of the of the of the of the",
        3: "the lease is subject to the terms of the public license",
        4: " ".join(["x", *mpl, "y"]),
        5: f"{prose(50, 5)} {' '.join(bsd)} {prose(9, 6)} {' '.join(bsd)}",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.license_labels(docs).collect()}
    assert all(got[k].labels == "" and got[k].score == 0 for k in (1, 2, 3))
    assert (got[4].labels, got[4].score, got[5].labels, got[5].score) == ("mpl", 1.0, "bsd", 1.0)
    assert {(r.doc_id, r.first_word, r.last_word) for r in license_scan.spans(docs, ["doc_id"]).collect()} == {
        (4, 1, 14), (5, 50, 70), (5, 80, 100),
    }


# --- 8 packing and 9 records ----------------------------------------------------------------


def ids_of(path, text, end):
    return np.array(Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_packing_places_every_token_once(spark, odd_docs, no_docs):
    pieces = packing.pack(odd_docs, WORDS_49K, 1, window=256).collect()
    want = Counter((r.doc_id, ids_of(WORDS_49K, r.text, 1).tobytes()) for r in odd_docs.collect())
    starts = Counter()
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length and zlib.crc32(p.ids) == p.ids_crc32
        starts[p.doc_id] += p.length
    totals = Counter()
    for (doc, data), n in want.items():
        totals[doc] += n * len(data) // 4
    assert starts == totals
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    last = max(by_sequence)
    for k, spans in by_sequence.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 256 or k == last
    assert packing.pack(no_docs, WORDS_49K).count() == 0


def test_windows_hold_the_shares(spark):
    totals = np.array([700_000, 200_000, 90_001, 13], np.int64)
    ranks = np.arange(0, totals.sum(), 2048)
    given = packing.due_before(totals, ranks)
    assert (given.sum(axis=1) == ranks).all() and (np.diff(given, axis=0) >= 0).all()
    assert np.abs(given - ranks[:, None] * totals / totals.sum()).max() <= 2


def test_longest_runs_of_all_places_at_once():
    equal = np.random.default_rng(3).random((300, 16)) < 0.8
    equal[0], equal[1] = True, False
    for row, first, size in zip(equal, *substring_dedup.longest_runs(equal), strict=True):
        runs = [(m.end() - m.start(), -m.start()) for m in re.finditer("1+", "".join("01"[int(x)] for x in row))]
        want = max(runs, default=(0, 0))
        assert size == want[0] and (size == 0 or first == -want[1])


def plain_paragraphs(make, text):
    """Anchors window by window and band keys shingle by shingle, for one text."""
    words = [int(x) for x in word_hashes(ascii_words(text))]
    mix = lambda columns: int(chained([np.array([c], np.uint64) for c in columns])[0])
    pairs = [int(mixed(np.array([mix(x)], np.uint64))[0]) >> 20 for x in zip(words, words[1:])]
    at = sorted({min(range(i, i + make.reach), key=lambda k: (pairs[k], k)) for i in range(len(pairs) - make.reach + 1)})
    at = [i for i in at if i + make.length <= len(words)]
    least = lambda i, f: min(mix(words[k : k + 5]) * int(f) % 2**64 for k in range(i, i + make.length - 4))
    return [(i, np.array([mix([0, *(least(i, f) for f in make.factors)])], np.uint64).view(np.int64)[0]) for i in at]


def test_paragraphs_of_texts_taken_together(odd_docs, prose):
    texts = [r.text for r in odd_docs.where("doc_id <> 6 or doc_id is null").collect()]
    texts += [prose(n, 3000 + n) for n in (15, 16, 17, 24, 25, 200)] + ["a " * 40, "a b " * 30, None, ""]
    for reach in (1, 3, 9):
        make = substring_dedup.Paragraphs(16, reach, 5, 1, 2)
        owner, at, keys = make.keys_of(texts)
        got = list(zip(owner.tolist(), at.tolist(), keys[:, 0].tolist(), strict=True))
        assert got == [(n, i, key) for n, text in enumerate(texts) for i, key in plain_paragraphs(make, text or "")]
        assert len(make.keys_of([None, "", "one"])[0]) == 0


def test_texts_that_agree_again_are_found_as_by_trying_all():
    for trial in range(40):
        draw = random.Random(trial)
        some = lambda n: [b"w%d" % draw.randrange(2 + trial % 9) for _ in range(n)]
        a = some(150)
        b = some(30) + a[20:110] + some(30)
        x, y = (substring_dedup.Text(word_hashes(w), 5) for w in (a, b))
        pair = substring_dedup.Pair(x, y, 0.8)
        runs = [(i, j) for i in range(146) for j in range(146) if a[i : i + 5] == b[j : j + 5]]
        for _ in range(60):
            i, j, most = draw.randrange(150), draw.randrange(150), draw.randrange(1, 120)
            after = {(p, q): p - i + q - j for p, q in runs if p >= i and q >= j}
            before = {(p + 4, q + 4): i - p + j - q - 8 for p, q in runs if p + 4 <= i and q + 4 <= j}
            for found, costs in ((pair.ahead(i, j, most), after), (pair.behind(i, j, most), before)):
                least = min(costs.values(), default=most + 1)
                assert (costs[found] == least) if least <= most else found is None


def test_texts_meet_spans_alike_at_any_size(spark, prose):
    docs = spark.createDataFrame([(k, prose(80, 60 + k // 2)) for k in range(8)], "doc_id long, text string")
    cut = substring_dedup.drop_repeats(docs)
    plan = cut._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {r.doc_id: r.removed_words for r in cut.collect()} == {k: 80 * (k % 2) for k in range(8)}


def test_windows_are_found_in_few_steps(monkeypatch):
    totals, calls, due = np.array([7_000_000, 2_000_000, 900_001, 13, 13], np.int64), [], packing.due_before
    monkeypatch.setattr(packing, "due_before", lambda *a: calls.append(1) or due(*a))
    queue = np.repeat(np.arange(5), [500, 500, 500, 13, 13])
    token = np.concatenate([np.arange(0, n, step) for n, step in zip(totals, (14_000, 4_000, 1_801, 1, 1), strict=True)])
    found = packing.rank_of(totals, queue, token, 2048)
    assert len(calls) <= 4
    assert (due(totals, (found + 1) * 2048)[np.arange(len(queue)), queue] > token).all()
    assert (due(totals, found * 2048)[np.arange(len(queue)), queue] <= token).all()


def test_offsets_read_the_files_once(spark, odd_docs):
    path = scratch_path(spark, "records")
    records.write_records(odd_docs, path, BYTES_50K, 2)
    plan = records.token_offsets(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan


def test_records_round_trip(spark, odd_docs, no_docs):
    path, index = scratch_path(spark, "records"), scratch_path(spark, "index")
    records.write_records(odd_docs, path, BYTES_50K, 2)
    records.write_index(spark, path, index)
    rows = sorted(odd_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    want = Counter((r.doc_id, zlib.crc32(ids_of(BYTES_50K, r.text, 2).tobytes())) for r in rows)
    got = records.token_offsets(spark, path).collect()
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    shuffled = records.read_at(spark, path, spark.read.parquet(index).where("doc_id >= 6").orderBy(F.rand()))
    assert Counter(r.doc_id for r in shuffled.collect()) == Counter({6: 1, 7: 1, 8: 2, 10: 1})
    empty = scratch_path(spark, "records")
    records.write_records(no_docs, empty, BYTES_50K, 2)
    assert records.token_offsets(spark, empty).count() == 0


def test_damage_is_found():
    good = records.frame(records.payload_of(5, b"\x01\x00\x0a\x00", 2)) * 2
    assert [records.record_of(p)[1].tolist() for _, _, p in records.frames_in(memoryview(good))] == [[1, 10], [1, 10]]
    for at in (0, 9, 20, len(good) - 3):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(records.BrokenRecord):
            list(records.frames_in(memoryview(bytes(bad))))
    with pytest.raises(records.BrokenRecord):
        list(records.frames_in(memoryview(good[:-4])))
