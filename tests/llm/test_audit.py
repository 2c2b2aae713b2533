"""Token alignment, filter audit and URL filter, next to brute force and on odd input."""

import base64
import hashlib
import itertools
from collections import Counter, defaultdict
from math import exp, sqrt

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rollcall.llm import filter_audit, token_alignment, url_filter

BYTES_50K = public_tokenizers.path("byte_bpe_50k.json")
PIECES_32K = public_tokenizers.path("piece_bpe_32k.model")


# --- 11 alignment ------------------------------------------------------------------------


def byte_table():
    """Bytes by id from the file of ranks, which the operator does not read."""
    ranks = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read().split(b"\n")
    return {int(r.split()[1]): base64.b64decode(r.split()[0]) for r in ranks if r}


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BYTES_50K)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES_32K)
    table = byte_table()

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("\u2581", " ").encode()

    def encode(text):
        if not text:
            return [], []
        own_a = [(i, table[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
        own_b = [(i, piece(i)) for i in b.encode(text)]
        raw = (" " + text).encode()
        if b"".join(x for _, x in own_a) != raw or b"".join(x for _, x in own_b) != raw:
            return [], []
        return own_a, own_b

    return encode


def spans(tokens):
    out, at = [], 0
    for i, own in tokens:
        out.append((at, at + len(own), i))
        at += len(own)
    return out


def brute_alignment(texts, encode):
    rows, counts = {}, Counter()
    for name, text in texts:
        a, b = map(spans, encode(text))
        links = [(x, y) for x in a for y in b if x[1] == y[1]]
        counts.update((x[2], y[2]) for x, y in links)
        rows[name] = (a, b, links)
    top = defaultdict(int)
    for (_, y), c in counts.items():
        top[y] = max(top[y], c)
    out = {}
    for name, (a, b, links) in rows.items():
        cuts = [0, *sorted({x[1] for x, _ in links})]
        said = []
        for i, j in itertools.pairwise(cuts):
            said.append("|".join(",".join(str(x[2]) for x in own if i < x[1] <= j) for own in (a, b)))
        overlaps = sum(x[0] < y[1] and y[0] < x[1] for x in a for y in b)
        best = sum(counts[x[2], y[2]] == top[y[2]] for x, y in links)
        digest = hashlib.sha256(";".join(said).encode()).hexdigest() if said else ""
        out[name] = (len(a), len(b), len(said), overlaps, len(links), best, sum(counts[x[2], y[2]] for x, y in links), digest)
    return out


ODD_TEXTS = [
    None, "", " ", "  two  spaces ", "line\nbreak\n\nand  more\n", "\n", "\nfirst", "a \nb\n c", "tab\tin\x0bword", "<|endoftext|> </s> <0x41> <unk>",
    "x\u2581y", "İstanbul ﬁ Å é", "日本語 の テキスト 😀", "a\u00a0b\u3000c", "क़ ड़. ढ़!", "\u0000 \u200b", "it's we'll 12345 3.14", "a" * 5000, "end ", "e\u0301 \u0301x",
]


def test_alignment_equals_brute_force(spark, prose, libraries):
    texts = [(k, x) for k, x in enumerate([*ODD_TEXTS, *(prose(40, k) + "." for k in range(12)), prose(40, 1) + "."])]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = token_alignment.aligned_counts(docs, BYTES_50K, PIECES_32K).collect()
    want = brute_alignment(texts, libraries)
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_a, r.n_b, r.n_groups, r.n_overlaps, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == want[r.doc_id], texts[r.doc_id]


def test_alignment_spans(spark, prose, libraries):
    texts = [(1, prose(30, 5)), (2, None), (3, "ein Wörtchen\nmehr")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    for r in token_alignment.alignments(docs, BYTES_50K, PIECES_32K).collect():
        a, b = map(spans, libraries(dict(texts)[r.doc_id]))
        assert list(zip(r.a_ends, r.a_ids)) == [(y, i) for _, y, i in a] and list(zip(r.b_ends, r.b_ids)) == [(y, i) for _, y, i in b]
        want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] < y[1] and y[0] < x[1]}
        assert set(zip(r.overlap_a, r.overlap_b)) == want and len(r.overlap_a) == len(want)
        ends = sorted({x[1] for x in a} & {y[1] for y in b})
        assert r.group_a == [sum(e < x[1] for e in ends) for x in a] and r.group_b == [sum(e < y[1] for e in ends) for y in b]


def test_every_character_has_the_libraries_ids(libraries):
    own = token_alignment.pair(BYTES_50K, PIECES_32K)
    points = [*range(1, 0x3400), *range(0xA000, 0xA100), *range(0xAC00, 0xAD00), *range(0xF900, 0x10000), *range(0x1F300, 0x1F400)]
    texts = [f"{chr(c)} a{chr(c)} {chr(c)}b. a{chr(c)}, x\n{chr(c)} y" for c in points]
    for text, (a, b) in zip(texts, own.encode(texts), strict=True):
        want = libraries(text)
        assert (a.tolist(), b.tolist()) == tuple([i for i, _ in x] for x in want), text


def test_words_are_forgotten_and_learned_again(prose, libraries, monkeypatch):
    monkeypatch.setattr(token_alignment, "CACHED", 50)
    own = token_alignment.Pair(BYTES_50K, PIECES_32K)
    for k in range(6):
        text = prose(60, k)
        (a, b), = own.encode([text])
        assert (a.tolist(), b.tolist()) == tuple([i for i, _ in x] for x in libraries(text))


def test_alignment_on_odd_documents(spark, odd_docs, no_docs):
    rows = token_alignment.aligned_counts(odd_docs, BYTES_50K, PIECES_32K).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[3].n_a == by_id[4].n_b == 0 and by_id[3].groups_sha256 == "" and by_id[6].n_groups > 10_000 and None in by_id
    assert token_alignment.aligned_counts(no_docs, BYTES_50K, PIECES_32K).count() == 0
    assert token_alignment.alignments(no_docs, BYTES_50K, PIECES_32K).count() == 0


# --- 12 audit ----------------------------------------------------------------------------


def brute_audit(masks, letters):
    """``masks``: (part, set of failed letters, good, toxic) per document."""
    out, shapley = {}, Counter()
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        for order in map("".join, itertools.permutations(letters)):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [m for m in left if letter in m[1]]
                left = [m for m in left if letter not in m[1]]
                shapley[part, letter] += len(gone)
                redundant = sum(letter in m[1] for m in own) - len(gone)
                only = sum(m[1] == {letter} for m in own)
                out[part, order, step] = [len(left), len(gone), redundant, only, sum(m[2] for m in gone), sum(m[3] for m in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(df):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in df.collect()}


def failed(text):
    text = text or ""
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    out = set()
    if len(words) < 100:
        out.add("A")
    if 100 * len(set(words)) < 80 * len(words):
        out.add("B")
    if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text):
        out.add("C")
    if set(text) & set("#$%&*|"):
        out.add("D")
    return out


def test_audit_equals_brute_force(spark, prose, odd_docs, no_docs):
    texts = [prose(130, k % 7) for k in range(12)] + ["LOUD " * 120, "a # b", None, "", "SHORT & LOUD", prose(30, 1) * 5, prose(99, 3), prose(100, 3)]
    rows = [(k, x, ("en", None, "")[k % 3]) for k, x in enumerate(texts)]
    rows += [(3, texts[3], "en"), (None, texts[0], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    flags = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 30, 2)] + [(4, 0, 1), (6, None, None)]
    labels = spark.createDataFrame(flags, "doc_id long, quality int, toxic int")
    first = {}
    for k, x, _ in rows:
        if k is not None:
            first[x or ""] = min(k, first.get(x or "", k))
    masks = []
    for k, x, lang in rows:
        own = failed(x) | ({"E"} if k is not None and k > first[x or ""] else set())
        masks.append((lang or "", own, any(f[0] == k and f[1] == 1 for f in flags), any(f[0] == k and f[2] == 1 for f in flags)))
    got = audited(filter_audit.audit(docs, labels))
    assert got == brute_audit(masks, "ABCDE") and len(got) == 2 * 120 * 5
    assert filter_audit.audit(no_docs, labels).count() == 0
    none = labels.where("doc_id < 0")
    assert filter_audit.audit(odd_docs, none).agg(F.sum("good_lost"), F.max("step")).first() == (0, 5)


def test_audit_of_own_filters(spark):
    docs = spark.createDataFrame([(k, k % 4 == 0, k % 3 == 0, None) for k in range(24)], "doc_id long, x boolean, y boolean, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = audited(filter_audit.audit(docs.withColumn("text", F.lit("")), labels, {"X": F.col("x"), "Y": F.col("y")}, repeats=None))
    assert got == brute_audit([("", {c for c, bad in (("X", k % 4 == 0), ("Y", k % 3 == 0)) if bad}, 0, 0) for k in range(24)], "XY")
    with pytest.raises(ValueError):
        filter_audit.audit(docs.withColumn("text", F.lit("")), labels, {c: F.col("x") for c in "ABCDEFGHI"})


# --- 13 URLs -----------------------------------------------------------------------------

ODD_URLS = [
    None, "", "no scheme", "://", "http://", "http://HOST.Com", "http://a.com/x?y#z", "https://b.net?q=/p", "x://y://z/p", "http://É.org/ä#", "http://a.com" + "/p" * 20_000,
    "http://example.com/en/", "http://example.com/en", "http://www.example.com/en/1", "http://a.www.example.com/en/1", "http://myexample.com/en/1", "http://x.net/es/1", "http://net/fr/", "http://internet/fr/",
    "http://com", "http://com/",
]


def parts_of(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fit = [r for r in url_filter.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fit, key=lambda r: len(r[1] + r[2]), default=None)


def test_rules_and_parts_of_urls(spark):
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(ODD_URLS)], "page_id long, url string, host string")
    model = url_filter.train(url_filter.labelled_urls(spark))
    got = {r.page_id: r for r in url_filter.judge(pages, model).collect()}
    assert len(got) == len(ODD_URLS)
    for k, url in enumerate(ODD_URLS):
        host, path = parts_of(url)
        rule = rule_of(host, path)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule and rule[1] + rule[2]), url
        assert got[k].verdict == (rule[0] if rule else "block" if got[k].score >= 0.5 else "allow"), url
        if not host + path:
            assert got[k].score == 0 and got[k].verdict == "allow"


def test_regression_equals_plain_descent(spark):
    """The same features, trained epoch by epoch in Python."""
    labelled = url_filter.labelled_urls(spark).limit(12).unionByName(url_filter.labelled_urls(spark).where("label = 0").limit(12))
    own = labelled.select("label", url_filter.features(url_filter.host(F.col("url")), url_filter.path(F.col("url"))).alias("b")).collect()
    w, bias = defaultdict(float), 0.0
    for _ in range(url_filter.EPOCHS):
        errors = [r.label - 1 / (1 + exp(-(bias + sum(w[b] for b in r.b) / sqrt(len(r.b))))) for r in own]
        slope = defaultdict(float)
        for r, e in zip(own, errors, strict=True):
            for b in r.b:
                slope[b] += e / sqrt(len(r.b)) / len(own)
        for b in slope:
            w[b] += url_filter.RATE * (slope[b] - url_filter.DECAY * w[b])
        bias += url_filter.RATE * sum(errors) / len(own)
    model = url_filter.train(labelled).first()
    assert abs(model.bias - bias) < 1e-6
    assert max(abs(model.weights[b] - w[b]) for b in range(url_filter.BUCKETS)) < 1e-6


def test_regression_tells_names_apart(spark):
    urls = [f"https://{before}{name}.example.org/de/{k}" for k, name in enumerate(["casino-games", "cheap-pills", "poker-spam", "adult-tube"]) for before in ("", "www.", "m.")]
    fine = [f"http://{name}.example.org/de/{k}#top" for k, name in enumerate(["science-museum", "news", "weather", "thering", "library"])]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls + fine)], "page_id long, url string")
    got = {r.url: r.verdict for r in url_filter.judge(pages, url_filter.train(url_filter.labelled_urls(spark))).collect()}
    assert {got[u] for u in urls} == {"block"} and {got[u] for u in fine} == {"allow"}


def test_urls_without_labels_or_rows(spark):
    nothing = spark.createDataFrame([(None, 1), ("http://x.org/", None), ("http://x.org/", 7)], "url string, label int")
    model = url_filter.train(nothing)
    pages = spark.createDataFrame([(1, "http://x.org/"), (1, "http://x.org/")], "page_id long, url string")
    rows = url_filter.judge(pages, model, rules=[]).collect()
    assert [(r.score, r.rule) for r in rows] == [(0.5, None)] * 2
    assert url_filter.judge(pages.where("page_id < 0"), model).count() == 0


def test_bounded_training_table(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MOST_LABELLED", 5)
    assert url_filter.train(url_filter.labelled_urls(spark)).count() == 1


# --- token ids of operators 8 and 9 ------------------------------------------------------


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_word_ids_of_every_letter_are_the_library_s(name):
    from rollcall.llm.tokens import TextEncoder

    own = TextEncoder(public_tokenizers.path(name))
    library = Tokenizer.from_file(public_tokenizers.path(name))
    points = [c for c in range(0x21, 0x20000) if not 0xD800 <= c < 0xE000 and chr(c).isalnum() and not 0x3400 <= c < 0xA000 and not 0xAC00 <= c < 0xD7A4]
    texts = [f"{chr(c)} a{chr(c)}b x{chr(c)}. {chr(c)}, {chr(c)}z; b{chr(c)}! {chr(c)}{chr(c)}? e{chr(c)}:" for c in points]
    for text, found in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = [int.from_bytes(own.encode(text)[k : k + own.dtype.itemsize], "little") for k in range(0, len(own.encode(text)), own.dtype.itemsize)]
        assert ids == found.ids, (text, hex(ord(text[0])))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_marks_after_letters_are_encoded_once(name, monkeypatch):
    from rollcall.llm.tokens import MARKS, TextEncoder

    own, asked = TextEncoder(public_tokenizers.path(name)), []
    library = Tokenizer.from_file(public_tokenizers.path(name))
    ask = own._library
    monkeypatch.setattr(own, "_library", lambda text: asked.append(text) or ask(text))
    runs = [*MARKS, "***", "&&&", "$$$", "...", "?!", ")).", "_-", "#|", "<|", "|>"]
    text = " ".join(f"{word}{run}" for run in runs for word in ("quidditch", "Élan", "zu", "s", "don't", "x1"))
    assert np.frombuffer(own.encode(text), own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids
    asked.clear()
    own.encode(" ".join(f"new{chr(97 + k)}{run}" for run in runs for k in range(26)))
    assert not asked
