"""Decontamination, media, URL rules and near-duplicates against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from readlens.llm import decontam, media, neardup, textvec, urlfilter

from .conftest import EDGES

WORD = re.compile(r"[^\W_]+")


def words_of(text):
    return [w.lower() for w in WORD.findall(text or "")]


def shingles_of(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def corpus():
    """Texts with planted passages of 50 words and more, near and exact copies."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(4000)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = make(60)
    texts = [make(rng.randint(3, 400)) for _ in range(150)]
    texts += [make(15) + passage + make(rng.randint(10, 60)) for _ in range(40)]
    for base in [t for t in texts[:12] if len(t) > 60] + texts[150:156]:
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(copy)
    texts += [list(texts[0])] * 3
    return [" ".join(t).capitalize() + "." for t in texts]


def test_near_duplicates_equal_brute_force(spark, corpus):
    df = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.classes(df).collect()}
    ids: dict = {}
    sequences = []
    for text in corpus:
        w = words_of(text)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)]
        sequences.append(np.array([ids.setdefault(g, len(ids)) for g in grams], np.uint64))
    root = list(range(len(corpus)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(corpus)):
        for b in range(a):
            if sequences[a].tolist() == sequences[b].tolist() or neardup.similarity(sequences[a], sequences[b], 0.8) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert got == {k: find(k) for k in range(len(corpus))}
    assert len(set(got.values())) < len(corpus) - 20
    kept = neardup.deduplicate(df.withColumnRenamed("text", "text")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(got.values()))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_banded_alignment_is_exact_above_its_bound():
    rng = random.Random(5)
    for _ in range(500):
        a = [rng.randrange(6) for _ in range(rng.randint(1, 14))]
        b = [x for x in a if rng.random() > 0.1] or [1]
        for _ in range(rng.randint(0, 2)):
            b.insert(rng.randint(0, len(b)), rng.randrange(6))
        n = lcs(a, b)
        wanted = n / (len(a) + len(b) - n)
        got = neardup.similarity(np.array(a, np.uint64), np.array(b, np.uint64), 0.6)
        assert abs(got - wanted) < 1e-9 if wanted >= 0.6 else got < 0.6


def test_near_duplicate_edge_cases(edges, nothing):
    rows = neardup.classes(edges).collect()
    assert len(rows) == len(EDGES)
    by = {r.doc_id: r.class_id for r in rows if r.doc_id is not None}
    assert by[1] == 1 and by[3] == 2 and by[2] == 2  # null and empty are one class
    kept = neardup.deduplicate(edges)
    assert kept.columns == edges.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [1, 2, 4, 5, 6, 7]
    assert [r.text for r in kept.filter("doc_id is null").collect()] == ["an orphan row"]  # the null text is of the class of 2
    assert neardup.classes(nothing).count() == 0 and neardup.deduplicate(nothing).count() == 0


def test_near_duplicates_of_repeated_and_textual_ids(spark):
    rng = random.Random(9)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    rows = [("x1", a, 1), ("x1", b, 2), ("x2", c, 3), ("x3", b + " more", 4), (None, c, 5), (None, a + " end", 6)]
    df = spark.createDataFrame(rows, "doc_id string, text string, h1 int")
    got = neardup.classes(df)
    assert dict(got.dtypes)["doc_id"] == "string" and len({r.class_key for r in got.collect()}) == 3
    kept = neardup.deduplicate(df)
    assert kept.columns == df.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([("x1", a), ("x1", b), ("x2", c)])


def test_chains_of_near_duplicates_equal_brute_force(spark):
    """Texts that drift apart word by word, so that classes are chains, and centres of all turns are needed."""
    rng = random.Random(11)
    texts = []
    for _ in range(3):
        words = [f"c{rng.randrange(10**6)}" for _ in range(50)]
        for _ in range(60):
            words = [*words, f"c{rng.randrange(10**6)}"][rng.randrange(2) :]
            texts.append(" ".join(words))
    sequences = [textvec.shingles(*(textvec.words([t])[i] for i in (0, 3)))[0] for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if neardup.similarity(sequences[a], sequences[b], 0.8) >= 0.8 and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(root))


def test_shared_passages_make_few_comparisons(spark, monkeypatch):
    """2,000 texts of which a passage fills five sixths: none are linked, and comparisons grow with the texts, not their pairs."""
    rng = random.Random(3)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(90)]
    made = []
    compared = neardup._compared

    def counted(pairs, *rest):
        made.append(pairs.count())
        return compared(pairs, *rest)

    monkeypatch.setattr(neardup, "_compared", counted)
    rows = [(k, " ".join([*(f"u{rng.randrange(10**6)}" for _ in range(18)), *passage])) for k in range(2000)]
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.class_id for r in got}) == 2000
    assert sum(made) < neardup.BANDS * 2000


def test_copies_with_too_many_changes_make_few_comparisons(spark, monkeypatch):
    """400 copies of a text with four changed words each: places and sizes allow links, what they have in common doesn't."""
    rng = random.Random(5)
    base = [f"b{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for _ in range(400):
        words = base[:]
        for at in rng.sample(range(120), 4):
            words[at] = f"n{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    sequences = [textvec.shingles(*(textvec.words([t])[i] for i in (0, 3)))[0] for t in texts]
    labelled = [neardup._labelled(s, np.zeros(len(s), np.int64)) for s in sequences]
    odd = [neardup.parities(s) for s in labelled]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            differ = sum(int(x).bit_count() for x in (odd[a] ^ odd[b]).view(np.uint64))
            assert differ <= len(np.setxor1d(labelled[a], labelled[b]))
            if neardup.similarity(sequences[a], sequences[b], 0.8) >= 0.8 and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    made = []
    compared = neardup._compared

    def counted(pairs, *rest):
        made.append(pairs.count())
        return compared(pairs, *rest)

    monkeypatch.setattr(neardup, "_compared", counted)
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(root))
    assert sum(made[1:]) < 5 * len(texts), made


def test_decontamination_equals_brute_force(spark, corpus):
    rng = random.Random(2)
    items = []
    for k in range(30):
        w = words_of(rng.choice([t for t in corpus if len(words_of(t)) > 60]))
        start = rng.randrange(len(w) - 50)
        part = w[start : start + rng.choice([6, 12, 20, 45])]
        if k % 3 == 0:
            part[len(part) // 2] = "zzz"
        items.append((k, " ".join(part).upper()))
    items += [(90, "of"), (91, None), (92, " ! "), (93, " ".join(words_of(corpus[0])[:2])), (None, corpus[3]), (0, items[0][1])]
    docs = [(k, t) for k, t in enumerate(corpus)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.containment for r in decontam.search(df, bench).collect()}
    wanted = {}
    for d, text in docs:
        own, w = shingles_of(text), words_of(text)
        for i, item in items:
            s = shingles_of(item)
            n = len(words_of(item))
            if i is None or not s:
                continue
            if n < 5:
                if any(tuple(w[k : k + n]) in s for k in range(len(w) - n + 1)):
                    wanted[d, i] = 1.0
            elif len(s & own) >= 0.8 * len(s):
                wanted[d, i] = len(s & own) / len(s)
    assert got == wanted and len(wanted) > 40
    clean = decontam.remove(df.selectExpr("*", "1 as clean", "'x' as id"), bench)
    assert sorted(r.doc_id for r in clean.collect()) == sorted({d for d, _ in docs} - {d for d, _ in wanted})
    assert clean.columns == ["doc_id", "text", "clean", "id"]


def test_items_of_few_shingles_are_always_found():
    rng = random.Random(5)
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(400)] for _ in range(40)]
    items, wanted = [], set()
    for k, text in enumerate(texts):
        for n in (5, 6, 7, 9, 11):
            start = rng.randrange(400 - n)
            part = text[start : start + n]
            if n > 8 and start % 2:
                part[-1] = "zzz"  # 4 of 5 and 6 of 7 shingles stay
            wanted.add((k, len(items)))
            items.append((len(items), " ".join(part)))
    items.append((len(items), " ".join(texts[0][:8] + ["zzz"] * 2)))  # 4 of 6
    got = decontam.hits(decontam.Index.of(items), [" ".join(t) for t in texts], 0.8)
    assert {(k, item) for k, own in enumerate(got) for item, _ in own} == wanted


def test_decontamination_edge_cases(spark, edges, nothing):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy")], "item_id long, text string")
    assert [r.doc_id for r in decontam.search(edges, bench).collect()] == [1, 1]
    assert decontam.search(nothing, bench).count() == 0
    assert decontam.search(edges, bench.filter("false")).count() == 0
    assert decontam.remove(edges, bench).count() == len(EDGES) - 2


def naive_png_rows(rows, kinds):
    raw, before = b"", [0] * len(rows[0])
    for row, kind in zip(rows, kinds):
        out = []
        for i, x in enumerate(row):
            a, b, c = row[i - 1] if i else 0, before[i], before[i - 1] if i else 0
            d = [abs(b - c), abs(a - c), abs(a + b - 2 * c)]
            guess = [0, a, b, (a + b) // 2, a if d[0] <= d[1] and d[0] <= d[2] else b if d[1] <= d[2] else c][kind]
            out.append((x - guess) & 255)
        raw, before = raw + bytes([kind]) + bytes(out), row
    return raw


def test_png_filters_and_checksums():
    rng = random.Random(1)
    rows = [[rng.randrange(256) for _ in range(7)] for _ in range(60)]
    raw = naive_png_rows(rows, [rng.randrange(5) for _ in rows])
    assert media._unfiltered(np.frombuffer(raw, np.uint8).reshape(60, 8)).tolist() == rows
    image = media.write_png(bytes(range(192)) * 9, 192)
    assert media.read_png(image).tobytes() == bytes(range(192)) * 9
    for broken in (image[:-3], b"x" + image[1:], image[:60] + bytes([image[60] ^ 1]) + image[61:]):
        with pytest.raises(media.MediaError):
            media.read_png(broken)
    with pytest.raises(media.MediaError):
        media.write_png(b"abc", 192)


def test_cosine_hash_is_that_of_the_plain_transform():
    rows = np.random.default_rng(4).integers(0, 256, (64, 192)).astype(np.uint8)
    cells = rows.reshape(32, 2, 32, 6).mean(axis=(1, 3))
    n = np.arange(32)
    plain = np.array([[(cells * np.outer(np.cos(np.pi * (2 * n + 1) * u / 64), np.cos(np.pi * (2 * n + 1) * v / 64))).sum() for v in range(8)] for u in range(8)])
    assert media.cosine_hash(rows) == np.packbits(np.round(plain, 6) > np.median(np.round(plain, 6))).tobytes()


def test_media_edge_cases(edges, nothing):
    rows = media.digests(edges, 192).collect()
    assert len(rows) == len(EDGES)
    for n, total, digest, tail in {(r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows}:
        assert total % 192 == 0 and total >= max(192, n)
        assert digest in {hashlib.sha256((e[1] or "").encode().ljust(total)).hexdigest() for e in EDGES}
        assert tail in {zlib.crc32((e[1] or "").encode().ljust(total)[-16:]) for e in EDGES}
    assert media.digests(nothing, 192).count() == 0
    back = media.features(media.store(edges, 192))
    assert sorted(bytes(r.payload)[: r.n_bytes] for r in back.collect()) == sorted((e[1] or "").encode() for e in EDGES)


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(2)
    rules = [(h, p, rng.choice(["block", "allow"])) for h, p in [("net", "/"), ("example.net", "/en/"), ("example.com", "/de/"), ("org", "/fr/"), ("a.b", "/"), ("b", "/a/"), ("x.a.b", "/"), ("a.b", "/a/b"), ("b", ""), ("a0.b", "/")]]
    urls = [None, "", "x", "http://", "https://NET/", "ftp://a.b:80/x?y#z", "http://a.b#://c/d", "http://a.b\n/x"]
    for _ in range(600):
        host = ".".join(rng.choice(["a", "b", "net", "com", "example", "x-y", "a0", "A"]) for _ in range(rng.randint(1, 4)))
        urls.append("http://" + host + rng.choice(["", "/", "/en/x", "/de/", "/fr/q?z", "/a/b/c", "?x", "#y/en/"]))

    def brute(url):
        host = path = ""
        if url is not None and "://" in url:
            m = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1])
            host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
        fits = [(len(h + p), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    df = spark.createDataFrame([(k, u, "clash", "block") for k, u in enumerate(urls)], "page_id long, url string, key string, verdict string")
    out = urlfilter.judge(df, spark.createDataFrame(rules, "host string, path string, action string"))
    assert {r.id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()} == {k: brute(u) for k, u in enumerate(urls)}
    none = spark.createDataFrame([], "host string, path string, action string")
    assert {r.verdict for r in urlfilter.judge(df, none).collect()} == {"allow"}
    assert urlfilter.judge(df.filter("false"), none).count() == 0
    twice = urlfilter.judge(df.filter("page_id < 3").unionAll(df.filter("page_id < 3")), none)
    assert twice.count() == 6


def test_words_and_shingles():
    hashes, starts, stops, offsets, _, _ = textvec.words(["Hello wörld hello", "", "WÖRLD x"])
    assert hashes[0] == hashes[2] and hashes[1] == hashes[3] and offsets.tolist() == [0, 3, 3, 5]
    own, own_offsets = textvec.shingles(hashes, offsets)
    assert own_offsets.tolist() == [0, 1, 1, 2]
