"""Toxicity, collocations and token alignment against plain versions of themselves."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from repeatloom.llm import alignment, blocks, collocations, toxicity
from repeatloom.llm.queries import QUERIES, tokenizer_file
from tests.llm.conftest import frame

SF = "/root/testdata/sf0.001"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def same(got, expected):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


@pytest.fixture(params=["odd", "empty", "documents"])
def docs(request):
    return request.getfixturevalue(request.param)


# toxicity

SMALL = toxicity.Training(bits=16, smoothing=2.0)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int, score string")


def insults(n):
    draw = random.Random(4)
    rows, marks = [], []
    for i in range(n):
        words = [draw.choice(["harbour", "ship", "quiet", "winter", "bread", "mountain", "river"]) for _ in range(30)]
        if i % 4 == 0:
            words[draw.randrange(30)] = "grobz" + draw.choice(["a", "en", "ot", "ik"])
        rows.append((i, " ".join(words), "s"))
        marks.append((i, int(i % 4 == 0), "x"))
    return rows, marks


def test_ngrams_are_those_of_the_whole_text():
    how = toxicity.Training(bits=20)
    text = "Ängste, ein   Satz\n" * 9000
    every = " " + text.lower() + " "
    grams = {every[i:i + n] for n in how.sizes for i in range(len(every) - n + 1)}
    numbers = {}
    for g in grams:  # the number of an n-gram doesn't hang on where it stands
        h = 0
        for c in g:
            h = (h * int(toxicity._BASE) + ord(c) + 1) % 2**64
        numbers[g] = (h ^ h >> 29) * int(toxicity._MIX) % 2**64 >> 64 - how.bits
    assert toxicity.ngrams(text.encode(), how).tolist() == sorted(set(numbers.values()))
    worth = np.zeros(1 << how.bits)
    worth[sorted(set(numbers.values()))[::7]] = 1
    assert toxicity.ngrams(text.encode(), how, worth).tolist() == sorted(set(numbers.values()))[::7]
    assert not len(toxicity.ngrams(None, how)) and not len(toxicity.ngrams(b"", how))


def test_unseen_signs_have_no_ratio():
    r = toxicity.log_ratios(np.array([0, 5, 0, 50]), np.array([0, 45, 9, 0]), 10, 90, toxicity.Training(least=0.0, smoothing=3.0))
    assert abs(r[0]) < 1e-12 and abs(r[1]) < 1e-12 and r[2] < 0 < r[3]


def test_trained_as_in_one_process(spark):
    rows, marks = insults(300)
    docs = frame(spark, rows + rows[:40])  # repeated rows are fitted once
    model = toxicity.train(docs, labels_of(spark, marks + marks[:9]), SMALL)
    chosen = sorted(((crc32(str(i).encode()), str(i)), t, y) for (i, t, _), (_, y, _) in zip(rows, marks)
                    if crc32(str(i).encode()) % 5)
    counts = np.zeros((2, 1 << SMALL.bits))
    for _, t, y in chosen:
        counts[y, toxicity.ngrams(t.encode(), SMALL)] += 1
    up = sum(y for *_, y in chosen)
    ratios = toxicity.log_ratios(counts[1], counts[0], up, len(chosen) - up, SMALL)
    plain = toxicity.regression([(toxicity.ngrams(t.encode(), SMALL, ratios), y) for _, t, y in chosen], ratios, SMALL)
    assert np.array_equal(model.weights, plain.weights) and model.intercept == plain.intercept
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, SMALL).collect()}
    for i, t, _ in rows:
        grams = set(toxicity.ngrams(t.encode(), SMALL).tolist())
        z = sum(float(plain.weights[g]) for g in grams) + plain.intercept
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9
        assert (got[i] >= 0.5) == ("grobz" in t)


def test_held_out_labels_are_not_learnt(spark):
    rows, marks = insults(200)
    turned = [(i, 1 - y if crc32(str(i).encode()) % 5 == 0 else y, s) for i, y, s in marks]
    docs = frame(spark, rows)
    one, other = (toxicity.train(docs, labels_of(spark, m), SMALL) for m in (marks, turned))
    assert np.array_equal(one.weights, other.weights) and one.intercept == other.intercept


def test_toxicity_of_odd_rows(spark, docs):
    model = toxicity.train(docs, labels_of(spark, [(5, 1, ""), (9, 0, ""), (None, 1, ""), (4, None, "")]), SMALL)
    got = toxicity.score(docs, model, SMALL)
    assert got.columns == ["doc_id", "score"] and got.count() == docs.count()
    assert got.where("score IS NULL OR score < 0 OR score > 1 OR isnan(score)").count() == 0
    nothing = toxicity.train(docs, labels_of(spark, []), SMALL)
    assert {r.score for r in toxicity.score(docs, nothing, SMALL).collect()} <= {0.0}


def test_toxicity_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op11_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    rows = got.select("predicted", "toxic").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.9


# collocations

def brute_phrases(rows, longest, least, top):
    count, words_of = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").encode().translate(LOWER).decode()
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            words_of[lang] += len(w)
            for k in range(1, longest + 1):
                count[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in count.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows, holders = [], defaultdict(int)
        for q, b in cand.items():
            for k in range(2, len(q)):
                for i in range(len(q) - k + 1):
                    holders[q[i:i + k]] = max(b, holders[q[i:i + k]])
        for p, a in cand.items():
            score, _, l, r = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            if 100 * holders[p] < 80 * a:
                rows.append((score, a, " ".join(p), l, r))
        rows.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, l, r, words_of[lang], s) for i, (s, a, p, l, r) in enumerate(rows[:top])]
    return out


@pytest.mark.parametrize(("least", "sent"), [(3, 0), (5, 10**6)])
def test_collocations(docs, least, sent):
    rows = [(r.text, r.lang) for r in docs.select("text", "lang").collect()]
    got = collocations.collocations(docs, least=least, top=300, sent=sent)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    same(got.collect(), brute_phrases(rows, 4, least, 300))


def test_collocations_of_repeated_words(spark):
    draw = random.Random(8)
    rows = [(i, "".join(draw.choice(["aa ", "bb ", "cc\t", "DD ", "ee.", "ff\n", "gg, ", "é "]) for _ in range(400)), "s")
            for i in range(60)]
    docs = frame(spark, rows, 5)
    plain = [(r.text, r.lang) for r in docs.select("text", "lang").collect()]
    same(collocations.collocations(docs, least=9, top=50).collect(), brute_phrases(plain, 4, 9, 50))


def test_blocks_end_where_pieces_end(monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", 10)
    monkeypatch.setattr(collocations, "SLICE", 7)
    text = b"aaa bbb ccc ddd eee. fff, ggg hhh iii! jjj"
    assert list(collocations.pieces_of(text)) == [b"aaa bbb ccc ddd eee", b" fff, ggg hhh iii", b" jjj"]
    words, word, place = collocations.numbered_words([b"aa bb. CC", b"", b"aa\tbb?dd"])
    assert words == [b"aa", b"bb", b"cc", b"dd"] and word.tolist() == [0, 1, 2, 0, 1, 3]
    gaps = np.diff(place)
    assert (gaps[[0, 3]] == 1).all() and (gaps[[1, 2, 4]] > 1).all()


def test_no_file_has_many_blocks_in_a_row_group(spark, monkeypatch):
    """A reader decodes a row group at once, so a task's memory must not follow the size of its file."""
    paths, new = [], blocks.scratch_path
    monkeypatch.setattr(blocks, "scratch_path", lambda *of: paths.append(new(*of)) or paths[-1])
    docs = spark.createDataFrame([("aa bb, aa bb", f"l{i}") for i in range(150)], "text string, lang string").coalesce(1)
    counts, _ = collocations.phrase_counts(docs, longest=3, least=2)
    assert counts.count() == 450
    held = defaultdict(list)
    for path in paths:
        for file in Path(path).glob("*.parquet"):
            meta = pq.ParquetFile(file).metadata
            held[Path(path).name.split("-")[0]] += [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]
    assert sum(held["words"]) == 150 and sum(held["places"]) >= 150
    assert max(held["words"] + held["places"]) == blocks.TOGETHER


def test_scores_beyond_64_bits(spark):
    """The score's arithmetic on counts that no test table reaches."""
    a, l, r = 7 * 10**15 + 1, 9 * 10**15, 8 * 10**15 + 3
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(
        F.expr("cast(2000000 * cast(a as decimal(38,0)) as decimal(38,0)) div cast(cast(l as decimal(38,0)) + cast(r as decimal(38,0)) as decimal(38,0))").alias("x"))
    assert row.first().x == 2000000 * a // (l + r)


# alignment

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def files():
    return tokenizer_file(A_FILE), tokenizer_file(B_FILE)


@pytest.fixture(scope="module")
def pair(files):
    return alignment.Pair(*files)


def brute_alignment(texts):
    """Plain loops over the libraries' own output."""
    a_lib = Tokenizer.from_file(public_tokenizers.path(A_FILE))
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(B_FILE))
    letters = alignment.byte_letters()
    docs = []
    for text in texts:
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        a_bytes = [bytes(letters[c] for c in a_lib.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else
                   b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(a_bytes) != (" " + (text or "")).encode() or b"".join(b_bytes) != (" " + (text or "")).encode():
            a, b, a_bytes, b_bytes = [], [], [], []
        spans = [[], []]
        for side, tokens in enumerate((a_bytes, b_bytes)):
            at = 0
            for t in tokens:
                spans[side].append((at, at + len(t)))
                at += len(t)
        links = []
        for i, (s, e) in enumerate(spans[0]):
            links += [(a[i], b[j]) for j, (x, y) in enumerate(spans[1]) if x < e and s < y]
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, begin = [], 0
        for end in common:
            groups.append("|".join(
                ",".join(str(k) for k, (s, e) in zip(ids, sp) if begin < e <= end) for ids, sp in ((a, spans[0]), (b, spans[1]))))
            begin = end
        docs.append((len(a), len(b), groups, links))
    count = Counter(p for *_, links in docs for p in set(links))
    top = {}
    for (x, _), n in count.items():
        top[x] = max(n, top.get(x, 0))
    return [(n_a, n_b, len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else "") for n_a, n_b, groups, links in docs]


TEXTS = [
    None, "", " ", "a", "two words", "two words", "Hello,  world!\n\n x", "<|endoftext|> and <s> </s> <unk>", "▁ and <0x41>",
    "日本語のテキスト and é é ﬁ ½", "tabs\tand\r\nlines", "🙂🙂 emoji 👩‍👩‍👧", "The ship sailed past the quiet harbour. " * 40,
    "antidisestablishmentarianism " * 15, "x" * 900, "1234567890 " * 30, "word", "word",
]


@pytest.mark.parametrize("size", [7, 50, alignment.RANGE])
def test_alignment(spark, files, size):
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string, n_a int")
    got = alignment.token_alignment(docs.repartition(3), *files, size=size)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    expected = [(i, *row) for i, row in enumerate(brute_alignment(TEXTS))]
    assert sorted(map(tuple, got.collect())) == expected
    assert sum(row[1] > 0 for row in expected) >= 10


def test_alignment_of_odd_rows(odd, empty, files):
    assert alignment.token_alignment(empty, *files).collect() == []
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    short = odd.where("length(text) < 3000 OR text IS NULL")
    rows = [(r.doc_id, r.text) for r in short.select("doc_id", "text").collect()]
    got = alignment.token_alignment(short, *files, size=300)
    same(got.collect(), [(i, *x) for (i, _), x in zip(rows, brute_alignment([t for _, t in rows]))])


def test_composition_is_associative(pair):
    (a, b), = pair.encode([("The harbour's ships, 23 of them: zwölf Schiffe im Hafen. " * 6).encode()])
    draw = random.Random(3)
    whole = alignment.whole(pair, alignment.fragments(pair, a, b, 1 << 20)[0])
    for size in (1, 2, 5, 33):
        parts = alignment.fragments(pair, a, b, size)
        assert any(not p.cut for p in parts) or size > 5
        while len(parts) > 1:
            i = draw.randrange(len(parts) - 1)
            parts[i:i + 2] = [alignment.compose(pair, parts[i], parts[i + 1])]
        got = alignment.whole(pair, parts[0])
        assert (got.groups, got.text) == (whole.groups, whole.text)
        assert np.array_equal(got.pairs, whole.pairs) and np.array_equal(got.times, whole.times)


def test_long_texts_in_parts_have_the_same_ids(pair, monkeypatch):
    text = "Some words, and 12  wide   gaps\n\nin lines. Größe der Häfen! " * 30
    whole = pair.encode([text.encode()])[0]
    monkeypatch.setattr(alignment, "PART", 40)
    parts = pair.encode([text.encode()])[0]
    assert pair.cuttable and len(list(pair._parts(text))) > 20
    assert all(np.array_equal(x, y) for x, y in zip(whole, parts))


def test_words_are_encoded_once(pair, monkeypatch):
    texts = [(t or "").encode() for t in TEXTS] + [
        t.encode() for t in ["x\u2581 y z", "a \u2581b a", " lead a", "trail a\n", "a  b\x1c c \x1cd", "a \u0301b a", "quiet quiet", "\x00 \x00 x"]]
    whole, seen, encode = pair._encode_whole(texts), [], pair._encode_whole
    monkeypatch.setattr(alignment, "PART", 50)
    monkeypatch.setattr(pair, "_encode_whole", lambda ts: seen.append(sum(map(len, ts))) or encode(ts))
    pair._forget()
    for _ in range(2):
        got = pair.encode(texts)
        assert all(np.array_equal(x, y) for a, b in zip(whole, got) for x, y in zip(a, b)) and len(got) == len(texts)
        assert 0 < sum(seen) < 0.75 * sum(map(len, texts))  # and nothing more in the second round
    monkeypatch.setattr(alignment, "KEPT_WORDS", 3)
    assert all(np.array_equal(x, y) for t, a in zip(texts, whole) for x, y in zip(a, pair.encode([t])[0]))
    assert len(pair.known) < 60


def test_alignment_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    expected = [(r.doc_id, *x) for r, x in zip(rows, brute_alignment_fast([r.text for r in rows]))]
    same(QUERIES["op13_token_alignment"](spark, SF).collect(), expected)


def brute_alignment_fast(texts):
    """As above with merged walks, for whole tables."""
    lib = alignment.Pair(tokenizer_file(A_FILE), tokenizer_file(B_FILE))
    docs = []
    for text in texts:
        a = lib.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = lib.b.encode(text) if text else []
        if b"".join(lib.a_bytes[i] for i in a) != (" " + (text or "")).encode() or \
                b"".join(lib.b_bytes[i] for i in b) != (" " + (text or "")).encode():
            a, b = [], []
        i = j = 0
        ends, links, groups, group = [0, 0], [], [], ([], [])
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            ea, eb = ends[0] + len(lib.a_bytes[a[i]]), ends[1] + len(lib.b_bytes[b[j]])
            if ea <= eb:
                group[0].append(a[i])
                ends[0], i = ea, i + 1
            if eb <= ea:
                group[1].append(b[j])
                ends[1], j = eb, j + 1
            if ea == eb:
                groups.append("|".join(",".join(map(str, g)) for g in group))
                group = ([], [])
        docs.append((len(a), len(b), groups, links))
    count = Counter(p for *_, links in docs for p in set(links))
    top = {}
    for (x, _), n in count.items():
        top[x] = max(n, top.get(x, 0))
    return [(n_a, n_b, len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else "") for n_a, n_b, groups, links in docs]
