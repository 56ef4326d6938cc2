"""Each operator against a brute-force version, on real texts and on odd ones."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F

from repeatloom.llm import (
    byte_bpe, chat, decontaminate, licenses, line_dedup, packed, piece_counts, quality, shingle_join, substring_dedup, syncmers,
)
from repeatloom.llm.queries import QUERIES, rank_file

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def lower(text):
    return (text or "").encode().translate(LOWER).decode()


def same(got, expected):
    key = lambda rows: sorted(map(repr, rows))
    assert key(map(tuple, got)) == key(expected)


@pytest.fixture(params=["odd", "empty", "documents"])
def docs(request):
    return request.getfixturevalue(request.param)


# 1 line dedup

def brute_lines(rows, ratio, least):
    pages, having = Counter(), Counter()
    for _, text, site in rows:
        if site is not None:
            pages[site] += 1
            having.update({(site, x.strip(" ")) for x in (text or "").split("\n")} - {(site, "")})
    bad = {k for k, n in having.items() if n >= least and n > ratio * pages[k[0]]}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in bad))
            for i, t, s in rows]


def test_line_dedup(docs):
    out = line_dedup.drop_boilerplate(docs, counts=("all_lines", "gone_lines"))
    assert out.columns[:len(docs.columns)] == docs.columns
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    same(out.select("doc_id", "text").collect(), brute_lines(rows, 0.1, line_dedup.MIN_PAGES))


def test_line_dedup_counts(odd):
    got = {r.doc_id: (r.a, r.g) for r in line_dedup.drop_boilerplate(odd, counts=("a", "g")).where("source = 's3'").collect()}
    assert got == {11: (3, 2), 12: (2, 1), 13: (2, 1), 14: (2, 1), 15: (2, 1), 16: (1, 1)}


# 2 syncmers

def xx(*values):
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else (v & (2**64 - 1)).to_bytes(8, "little")
        seed = xxhash.xxh64_intdigest(data, seed=seed)
    return seed - 2**64 if seed >= 2**63 else seed


def brute_codes(text):
    words = [w for w in re.split("[ \t-\r]+", text) if w]
    h = [xx(w) for w in words]
    g = [xx(a, b) for a, b in zip(h, h[1:])]
    at = [i for i in range(len(h) - 4) if min(g[i:i + 4]) in (g[i], g[i + 3])]
    if not words:
        return []
    return [xx(g[i], g[i + 2], g[i + 3]) for i in at] if at else [xx(" ".join(words))]


def brute_like(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def test_syncmers(docs):
    rows = sorted(pairs(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    expected = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        m = len(text) // 2
        new = text[:len(text) - m] + after[:m]
        a, b, c = brute_codes(text), brute_codes(new), brute_codes(after)
        show = lambda codes: "".join(f"{x & (2**64 - 1):016x}" for x in codes)
        expected.append((i, len(text), new, show(a), show(b), brute_like(a, b), brute_like(a, c)))
    same(syncmers.edited_fingerprints(docs).collect(), expected)


def test_syncmers_stay_on_the_jvm(documents):
    plan = syncmers.edited_fingerprints(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 3 byte-level BPE

def library(name):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(rank_file(name)),
                             special_tokens={})


def test_byte_bpe(docs):
    enc = library("byte_bpe_multi_50k.tiktoken")
    expected = [(i, len(ids := enc.encode_ordinary(t or "")), list(ids), (t or "").encode()) for i, t in pairs(docs)]
    same(byte_bpe.encoded(docs, rank_file(), public_tokenizers.PATTERN).collect(), expected)


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def test_appends_and_edits(name):
    enc, codec, r = library(name), byte_bpe.Codec(rank_file(name), public_tokenizers.PATTERN), random.Random(4)
    parts = ["the ", "ing", "aé", "  ", "\n", "你好", "日本", "x", "aaaa", "'s", " 12", "3", "--", "Zz", "é", "tion", "\t", " ", " ,", "\x1c", "\x85", " "]
    encoder = codec.pieces.encoder
    for _ in range(400):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        ids = enc.encode_ordinary(text)
        assert [int(i) for i in codec.encode(text).split(",") if i] == ids
        growing, cuts = byte_bpe.TextEncoding(encoder, public_tokenizers.PATTERN), sorted(r.choices(range(len(text) + 1), k=3))
        for a, b in zip([0, *cuts], [*cuts, len(text)]):
            growing.append(text[a:b])
        assert growing.ids() == ids
        old = text.encode()
        at = r.randint(0, len(old))
        gone, new = r.randint(0, min(4, len(old) - at)), bytes(r.choice(b"abthe ") for _ in range(r.randint(0, 3)))
        edited = old[:at] + new + old[at + gone:]
        assert encoder.edit(old, encoder.extend(old, []), edited, at, gone, len(new)) == encoder.extend(edited, [])
        assert encoder.walk(encoder.extend(old, [])) == encoder.merged(old)


# 4 chat

def brute_chats(rows):
    convs = defaultdict(set)
    for conv, turn, role, text in rows:
        convs[conv].add((turn is not None, turn or 0, role or "unknown", text or ""))
    said = {c: tuple((t[2], t[3]) for t in sorted(v)) for c, v in convs.items()}
    prefixes = {v[:n] for v in said.values() for n in range(1, len(v))}
    out = {}
    for c in sorted(said, key=lambda c: (c is None, c or 0)):
        if said[c] not in prefixes:
            out.setdefault(said[c], [c, 0])[1] += 1
    return [(c, len(v), n, "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in v)) for v, (c, n) in out.items()]


def test_chats(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"),
            (3, 2, "user", None), (4, 0, "user", "hi"), (4, 1, "assistant", "yes"), (4, 2, "user", ""), (5, 1, None, "a"), (5, 0, "user", "b"),
            (5, 0, "user", "b"), (6, None, "user", "x"), (6, 1, "user", "y"), (None, 0, "user", "nobody"), (None, 1, "user", "at all"),
            (7, 0, "b", "2"), (7, 0, "a", "1"), (8, 0, "user", "z" * 90_000), (9, 0, "user", "z" * 90_000), (9, 1, "user", "")]
    df = spark.createDataFrame([(*r, "c", "c") for r in rows], "conv_id long, turn long, role string, text string, conv string, POS string")
    same(chat.format_chats(df).collect(), brute_chats(rows))
    assert chat.format_chats(df.limit(0)).count() == 0
    plan = chat.format_chats(df)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_chats_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    same(chat.format_chats(table).collect(), brute_chats(map(tuple, table.select("conv_id", "turn", "role", "text").collect())))


# 5 licenses

def test_licenses(docs):
    out = {}
    for r in licenses.license_scan(docs).collect():
        out.setdefault(r.doc_id, []).append(r)
    for i, text in pairs(docs):
        words = WORD.findall(lower(text))
        starts = {p: [k for k in range(len(words)) if words[k:k + len(p.split())] == p.split()] for p in licenses.BASE_PHRASES}
        places = sorted(x for s in starts.values() for x in s)
        base = ",".join(sorted({licenses.BASE_PHRASES[p] for p, s in starts.items() if s}))
        for r in out[i]:
            if len(out[i]) == 1 or r.n_words == len(words):
                assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
                    len(words), len(places), min(places, default=None), max(places, default=None), base)
            assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_templates(spark):
    texts = [t[2] for t in licenses.TEMPLATES]
    df = spark.createDataFrame([(i, "before it some words " + t + " and after it") for i, t in enumerate(texts)]
                               + [(98, "the license of this work permits and requires you to use software"), (99, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    for i, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in got[i].labels.split(",") and f"{label}@4" in got[i].matches and got[i].score == 1.0
    assert (got[98].labels, got[98].score, got[99].labels, got[99].score) == ("", 0.0, "", 0.0)


def brute_notices(text, share=0.4):
    """Labels of all places of all templates that explain enough words and hold the phrase."""
    words, found = WORD.findall(lower(text)), set()
    for label, phrase, notice in licenses.TEMPLATES:
        own = WORD.findall(lower(notice))
        for start in range(1 - len(own), len(words)):
            window = words[max(0, start):start + len(own)]
            same = sum(0 <= start + k < len(words) and words[start + k] == w for k, w in enumerate(own))
            if same >= min(2, len(own)) and same / len(own) >= share and f" {' '.join(WORD.findall(phrase))} " in f" {' '.join(window)} ":
                found.add(f"{label}@{start}")
    return found


def test_license_files_with_several_notices(spark):
    notices = [t[2] for t in licenses.TEMPLATES]
    texts = [f"before it {a} and between them {b} and after it" for a, b in itertools.permutations(notices, 2)]
    texts += [" some words ".join(notices), " ".join(reversed(notices))]
    # Notices cut at both ends, behind a whole one, and with a word of one's own in the middle.
    whole = [n.split() for n in notices]
    texts += [f"{notices[3]} {' '.join(n[len(n) // 4:])} x {' '.join(n[:len(n) * 3 // 4])}" for n in whole]
    texts += [f"{' '.join(n[:len(n) // 2])} own {' '.join(n[len(n) // 2:])} {notices[5]}" for n in whole]
    # Words that only other documents make common turn the order of the votes.
    rest = ["mozilla mpl source code form subject terms public v 2 0"] * 90 + ["mit released under the license"] * 90
    df = spark.createDataFrame(list(enumerate(texts + rest)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    for i, text in enumerate(texts):
        expected = brute_notices(text)
        assert set(got[i].matches) == expected, text
        assert {m.split("@")[0] for m in expected} <= set(got[i].labels.split(","))
    assert {t[0] for t in licenses.TEMPLATES} <= set(got[len(notices) * (len(notices) - 1)].labels.split(","))


# 6 quality

def test_quality_learns_only_what_it_may(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = quality.train(docs, turned)
    assert (model[0] == other[0]).all() and model[1] == other[1]
    scored = quality.score(docs, model).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    assert sum((r.score >= 0.3) == r.quality for r in scored) / len(scored) > 0.9


def test_quality_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 1), (7, None), (None, 0), (99, 0), (11, 0)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    assert quality.score(odd, model).count() == odd.count()
    none = quality.train(odd, labels.limit(0))
    assert {r.score for r in quality.score(odd, none).collect()} == {0.5}
    assert quality.score(empty, model).count() == 0
    kept = quality.accepted(odd, model, 0.0)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    same(kept.collect(), [tuple(r) for r in odd.collect()])


# 7 decontamination

def brute_hits(text, items, width=10):
    words, hit, found = WORD.findall(lower(text)), set(), set()
    for item, t in items:
        w = WORD.findall(lower(t))
        size = min(width, len(w))
        windows = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i:i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


ITEMS = [(1, "THE quick, brown fox jumps over the lazy dog while twenty three"), (2, "own twelve"), (3, None), (4, ""), (5, "--"),
         (6, "one"), (7, "日本 语 x"), (1, "header line own fourteen"), (8, "w0x0 w1x1")]


@pytest.mark.parametrize("block_words", [1_000_000, 4])
def test_benchmark_hits(docs, spark, block_words):
    items = spark.createDataFrame([(*i, "c") for i in ITEMS], "item_id long, text string, doc_id string")
    hits = decontaminate.benchmark_hits(docs, items, block_words=block_words)
    rows = hits.select("doc_id", "n_words", "n_hit", "items").collect()
    same(rows, [(i, *brute_hits(t, ITEMS)) for i, t in pairs(docs)])
    clean = decontaminate.clean_rows(docs, items, block_words=block_words)
    assert clean.columns == docs.columns
    same(clean.select("doc_id").collect(), [(i,) for i, t in pairs(docs) if not brute_hits(t, ITEMS)[1]])


def test_hit_spans_are_characters_of_the_original(odd, spark):
    items = spark.createDataFrame([(7, "日本 语 x"), (8, "mit license the apache")], "item_id long, text string")
    texts = dict(pairs(odd.where("doc_id in (10, 19)")))
    for r in decontaminate.benchmark_hits(odd, items).where("n_hit > 0").collect():
        assert texts[r.doc_id][r.spans[0]:r.spans[1]] == {10: "日本 语 x", 19: "MIT License. The Apache"}[r.doc_id]


def test_no_benchmark(odd, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.benchmark_hits(odd, none).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.clean_rows(odd, none).count() == odd.count()


# 8 substring dedup

def brute_kept(rows, width=20):
    first, out = {}, []
    words = [(i, (t or "").encode().split()) for i, t in rows]
    at = lambda i, k: (i is not None, i or 0, k)
    for i, w in words:
        for k in range(len(w) - width + 1):
            key = tuple(w[k:k + width])
            first[key] = min(first.get(key, at(i, k)), at(i, k))
    for i, w in words:
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k:k + width])] < at(i, k):
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


@pytest.mark.parametrize("block_bytes,segment", [(4 << 20, 1 << 20), (20_000, 1_500)])
def test_substring_dedup(docs, block_bytes, segment):
    out = substring_dedup.remove_repeats(docs, block_bytes=block_bytes, segment_windows=segment)
    same(out.collect(), brute_kept(pairs(docs)))


# 9 token counts

def test_token_counts(docs):
    tokens = set(byte_bpe.read_ranks(rank_file()))
    longest = max(map(len, tokens))

    def greedy(word):
        n, left = 0, b" " + word
        while left:
            size = next(k for k in range(min(longest, len(left)), 0, -1) if left[:k] in tokens)
            n, left = n + 1, left[size:]
        return n

    words = [(i, (t or "").encode().split()) for i, t in pairs(docs)]
    same(piece_counts.token_counts(docs, rank_file()).collect(), [(i, len(w), sum(map(greedy, w)), 0) for i, w in words])


def test_longest_match_without_all_bytes():
    match = piece_counts.LongestMatch([b"a", b"ab", b"abcd", b"c", b"bcx"], b"")
    assert [match.count(w) for w in (b"", b"abc", b"abcd", b"abcx", b"abx", b"q", b"aab")] == [0, 2, 1, None, None, None, 2]


# 10 Jaccard join

def brute_groups(rows, width, num, den=100):
    sets, of = {}, defaultdict(set)
    for k, (i, text) in enumerate(rows):
        w = (text or "").encode().translate(LOWER).split()
        sets[k] = {tuple(w[j:j + width]) for j in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
        for s in sets[k]:
            of[s].add(k)
    top = {i: i for i, _ in rows}

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    less = lambda i: (i is not None, i or 0)
    for k in sets:
        for j in {j for s in sets[k] for j in of[s] if j < k}:
            common = len(sets[k] & sets[j])
            if den * common >= num * (len(sets[k]) + len(sets[j]) - common):
                a, b = sorted((find(rows[k][0]), find(rows[j][0])), key=less)
                top[b] = a
    return [(i, len(sets[k]), find(i) if sets[k] else i) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("width,num,block_bytes", [(4, 85, 4 << 20), (5, 80, 20_000)])
def test_similar_documents(docs, width, num, block_bytes):
    out = shingle_join.similar_documents(docs, width, num, block_bytes=block_bytes, segment_shingles=1_500)
    same(out.select("doc_id", "n_shingles", "component_id").collect(), brute_groups(pairs(docs), width, num))


def test_chains_and_families(spark):
    r = random.Random(7)
    vocabulary = [f"v{i}" for i in range(4000)]
    rows = []
    for family in range(6):
        base = [r.choice(vocabulary) for _ in range(r.choice((18, 60, 150, 400)))]
        for _ in range(30):
            words = list(base)
            for _ in range(r.randint(0, 4)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            rows.append((len(rows) * 7 % 997, " ".join(words)))
    chain = [r.choice(vocabulary) for _ in range(120)]
    for _ in range(25):  # each is like the one before and, by the end, unlike the first
        chain = chain[4:] + [r.choice(vocabulary) for _ in range(4)]
        rows.append((1000 + len(rows), " ".join(chain)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for width, num in ((4, 85), (5, 80), (4, 60)):
        out = shingle_join.similar_documents(df, width, num, block_bytes=9_000, segment_shingles=700)
        same(out.select("doc_id", "n_shingles", "component_id").collect(), brute_groups(rows, width, num))


def test_similar_sets_share_an_entry():
    """The promise of the prefixes, for any frequencies."""
    import numpy as np

    r = random.Random(3)
    for _ in range(3000):
        n = r.choice((1, 2, 5, 9, 15, 17, 33, 80, 200))
        universe = {r.getrandbits(64): r.choice((1, 1, 2, 3, 4, 5, 9)) for _ in range(2 * n)}
        keys = list(universe)
        a = set(r.sample(keys, n))
        b = (a - set(r.sample(sorted(a), r.randint(0, n // 6)))) | set(r.sample(keys, r.randint(0, n // 6)))
        if not b or 100 * len(a & b) < 85 * len(a | b):
            continue
        both = [shingle_join.signatures(np.array(sorted(x), np.uint64), np.array([universe[k] for k in sorted(x)], np.uint8), 85, 100)
                for x in (a, b)]
        assert set(both[0].tolist()) & set(both[1].tolist())


def test_packed_numbers():
    import numpy as np

    values = np.sort(np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64))
    assert (packed.unpack_sorted(packed.pack_sorted(values), 500) == values).all()
    firsts = packed.Layout(1, 7, 20).first_of(20)
    assert [int(v) * 7 >> 20 for v in firsts] == list(range(7)) and all((int(v) - 1) * 7 >> 20 < i for i, v in enumerate(firsts))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows
    for r in rows[:5]:
        for c, v in r.asDict().items():
            if c.endswith("sha256"):
                assert re.fullmatch("[0-9a-f]{64}", v) and len(hashlib.sha256(b"").hexdigest()) == len(v)


def thue_morse(n, flip=False):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_words_whose_sums_of_powers_are_equal(spark):
    """Two words of 1,024 letters that any odd base modulo 2 ** 64 hashes alike, in documents that are else the same."""
    rest = [f"w{i}" for i in range(19)]
    one, other = thue_morse(1024), thue_morse(1024, True)
    words = packed.BlockWords([one.encode(), other.encode()], streams=2)
    assert all(h[0] != h[1] for h in words.hashes)
    df = spark.createDataFrame([(1, " ".join([one, *rest])), (2, " ".join([other, *rest]))], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeats(df).collect()] == [0, 0]
    apart = spark.createDataFrame([(1, f"{one} b {one} d"), (2, f"{other} b {other} d")], "doc_id long, text string")
    assert sorted(r.component_id for r in shingle_join.similar_documents(apart).collect()) == [1, 2]


def test_own_license_phrases_need_no_template_word(spark):
    df = spark.createDataFrame([(1, "see foo bar here")], "doc_id long, text string")
    for templates in (licenses.TEMPLATES, ()):
        row = licenses.license_scan(df, phrases={"foo bar": "foo"}, templates=templates).first()
        assert (row.n_base, row.first_word, row.base_labels, row.score) == (1, 1, "foo", 0.5)


