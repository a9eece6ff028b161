"""Personal data: the formats against plain regexes, and bootstrapping on a small corpus."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from readlens.llm import pii

from .conftest import EDGES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from([*"ab.@-+ 0129()%_é", "@b.c", "1.2.3.4", "4432507379035540", "+1 (499) 555-6503", "a@b.c"]), max_size=25).map("".join))
def test_formats(text):
    assert pii.base_spans(text) == brute(text)


def test_hostile_texts_take_linear_time():
    for text in ("@" * 100_000, "1" * 100_000, "1." * 50_000, "a" * 100_000 + "@", "+1" * 50_000, "0." * 20_000 + "1" * 6000):
        pii.base_spans(text)
        pii.candidates(text)


def test_edge_cases(edges, nothing):
    rows = pii.report(edges).collect()
    assert len(rows) == len(EDGES)
    wanted = sorted(hashlib.sha256(pii.joined(pii.base_spans(e[1] or "")).encode()).hexdigest() for e in EDGES)
    assert sorted(r.base_sha256 for r in rows) == wanted
    assert pii.report(nothing).count() == 0
    out = pii.redact(edges)
    assert out.columns == edges.columns and out.count() == len(EDGES)
    assert sum(r.text is None for r in out.collect()) == 2
    assert any("[EMAIL]" in (r.text or "") for r in out.collect())
    assert pii.redact(nothing).count() == 0


def test_bootstrapping_finds_unseen_identifiers(spark):
    seeds = [(i, f"please call me at +1 555 010 1{i:03d} before noon") for i in range(12)]
    hidden = [(100, "please call me at 0170-99881 before noon"), (101, "the part number is 0170-99882 in the list"), (102, "my line is 0170-99881 too")]
    other = [(200 + i, f"lot {1000 + i} of the series {2000 + i} is sold") for i in range(20)]
    df = spark.createDataFrame(seeds + hidden + other, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.report(df).collect()}
    assert spans[100] == "like_phone:18:28"
    assert spans[102] == "like_phone:11:21"  # the same instance elsewhere
    assert spans[101] == "" and all(spans[200 + i] == "" for i in range(20))
    assert spans[0].startswith("phone:18:")
    text = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert text[100] == "please call me at [PHONE] before noon" and text[101] == hidden[1][1]


def test_bootstrapping_fills_slots_with_any_words(spark):
    rows = [(i, f"you can write to user{i:02d}@corp.example for more help") for i in range(12)]
    rows += [(i, f"please call me at +1 555 010 1{i:03d} before noon") for i in range(20, 32)]
    hidden = {100: "user@localhost", 101: "jane[at]corp", 102: "jdoe"}
    rows += [(k, f"you can write to {who} for more help") for k, who in hidden.items()]
    rows += [(103, "please call me at 0171 555 0199 before noon"), (104, "ask jane[at]corp now"), (105, "our friend jdoe came along"), (106, "0171 555 0199 is mine")]
    spans = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, who in hidden.items():
        assert spans[k] == f"like_email:17:{17 + len(who)}"
    assert spans[103] == "like_phone:18:31" and spans[106] == "like_phone:0:13"
    assert spans[104] == "like_email:4:16" and spans[105] == ""  # an ordinary word is none elsewhere


def test_bootstrapping_goes_on_until_nothing_is_added(spark):
    rows = [(i, f"ap aq user{i:02d}@corp.example ar at") for i in range(20)]
    rows += [(100 + i, f"ap aq a{i}-777 ar at") for i in range(8)]
    for step, (last, own) in enumerate(zip("abcde", "bcdef"), 2):  # each context has the last one's instances and new ones
        rows += [(100 * step + 10 * k + i, f"{own}p {own}q {name}{i}-777 {own}r {own}t") for k, name in enumerate((last, own)) for i in range(8)]
    how = pii.Bootstrap(min_confidence=0.3, accept=0.6)
    spans = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string"), how).collect()}
    assert all(spans[k].startswith("like_email:") for k in spans if k >= 100)


def test_scans_of_hostile_texts_take_linear_time():
    wanted = pii.Wanted(["a a _", "a _ a", "1 _ 1", "0 _ 0"], ["a a", "1"])
    for text in ("a " * 20_000, "1 " * 20_000, "a@b.c " * 10_000, "a" * 100_000, ". " * 50_000):
        pii.candidates(text, wanted)


def plain_word(token):
    return re.sub("[0-9]+", "0", token.strip(pii._EDGES).lower())


def plain_patterns(text, a, b):
    before = [w for t in text[:a].split() if (w := plain_word(t))][-3:]
    after = [w for t in text[b:].split() if (w := plain_word(t))][:2]
    out = [" ".join(before[k:]) + " _" for k in range(len(before) - 1)]
    out += [f"{before[-1]} _ {' '.join(after[:n])}" for n in range(1, len(after) + 1) if before]
    return out + ([f"{before[-2]} {before[-1]} _ {after[0]}"] if len(before) > 1 and after else [])


def plain_slots(text, base):
    """(start, end, patterns that this fills) of every run of words that touches no base span."""
    spots = []
    for m in re.finditer(r"\S+", text):
        token = m[0].lstrip(pii._EDGES)
        if bare := token.rstrip(pii._EDGES):
            spots.append((m.end() - len(token), m.end() - len(token) + len(bare)))
    for i, (a, _) in enumerate(spots):
        ends = []
        for _, b in spots[i : i + 6]:
            if any(x < b and a < y for _, x, y in base):
                break
            ends.append(b)
        digits = [bool(re.search("[0-9]", text[x:y])) for x, y in spots[i : i + len(ends)]]
        run = 0 if not digits or not digits[0] else (digits.index(False) if False in digits else len(digits)) - 1
        seen = set()
        for k, b in enumerate(ends):
            fills = [p for p in plain_patterns(text, a, b) if p not in seen and (not p.endswith("_") or k == run)]
            seen.update(fills)
            yield a, b, fills


def brute_bootstrap(texts, how):
    kinds, known = {}, set()
    for text in texts:
        for kind, a, b in brute(text):
            kinds[text[a:b]] = max(kind, kinds.get(text[a:b], ""))
            known |= {(p, text[a:b]) for p in plain_patterns(text, a, b)}
    slots = [[(a, b, text[a:b], f, plain_patterns(text, a, b)) for a, b, f in plain_slots(text, brute(text))] for text in texts]
    accepted, patterns, spans = {}, set(), set()

    def heavy(edges):
        mass = {}
        for p, kind, score in edges:
            mass[p, kind] = mass.get((p, kind), 0) + score
        return {k: m for k, m in mass.items() if m >= how.min_mass}

    seeded = {(p, i, kinds[i], 1.0) for p, i in known}
    patterns = {p for p, _ in heavy((p, k, s) for p, _, k, s in seeded)}
    while True:
        loose = {(p, i) for own in slots for _, _, i, fills, _ in own for p in fills if p in patterns and i not in kinds}
        graph = {(p, i) for p, i in known if p in patterns} | loose
        scores = {i: (k, 1.0) for i, k in kinds.items()} | accepted
        sure = {}
        for (p, kind), m in heavy((p, *scores[i]) for p, i in graph if i in scores).items():
            if m / (sum(q == p for q, _ in graph) + 1) >= how.min_confidence:
                sure[p, kind] = m / (sum(q == p for q, _ in graph) + 1)
        wrong = {}
        for p, i in loose:
            for (q, kind), c in sure.items():
                if p == q:
                    wrong[i, kind] = wrong.get((i, kind), 1.0) * (1 - c)
        best = {}
        for (i, kind), w in wrong.items():
            if 1 - w >= how.accept:
                best[i] = max(best.get(i, (0, "")), (1 - w, kind))
        before = set(accepted)
        accepted = accepted | {i: (kind, score) for i, (score, kind) in best.items()}
        fresh, spans = set(), set()
        for n, own in enumerate(slots):
            for a, b, i, fills, around in own:
                if i in accepted and (re.search(r"[@_\[\](){}]|([0-9].*){3}", i) or any((p, accepted[i][0]) in sure for p in fills)):
                    spans.add((n, a, b, accepted[i][0]))
                    fresh |= {(p, i, *accepted[i]) for p in around}
        more = patterns | {p for p, _ in heavy((p, k, s) for p, _, k, s in fresh | seeded)}
        if more == patterns and before == set(accepted):
            return spans
        patterns = more


def test_bootstrapping_equals_brute_force(spark):
    rng = random.Random(4)
    words = ["call", "write", "to", "me", "at", "now", "or", "the", "of", "soon"]
    frames = [("please call {} now or never", "+1 555 010 1{:03d}"), ("reach {} at home", "u{}@corp.example"), ("node {} went down", "10.0.0.{}")]
    texts = []
    for _ in range(400):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))]
        for _ in range(rng.randrange(3)):
            frame, seed = rng.choice(frames)
            own = rng.random()
            who = seed.format(rng.randrange(40)) if own < 0.8 else rng.choice(["jdoe", "0171 99 88", "anna[at]corp", "(x-4711)", "the boss"]) if own < 0.95 else " ".join(rng.choice(words) for _ in range(2))
            parts += [frame.format(who), " ".join(rng.choice(words) for _ in range(rng.randrange(4)))]
        if rng.random() < 0.1:
            parts.append(f"{rng.choice(words)} 0171 99 88 {rng.choice(words)} anna[at]corp.")
        texts.append(" ".join(parts))
    how = pii.Bootstrap(min_confidence=0.5, accept=0.7)
    wanted = brute_bootstrap(texts, how)
    got = set()
    for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), how).collect():
        got |= {(r.doc_id, int(a), int(b), kind[5:]) for kind, a, b in (s.split(":") for s in r.spans.split(",") if s.startswith("like_"))}
    assert got == wanted and len(got) > 50 and len({k for *_, k in got}) > 1


def test_redaction_of_clashing_names_and_textual_ids(spark):
    df = spark.createDataFrame([("x", "mail a@b.c", 1, "s", "k"), ("x", "mail d@e.f", 2, None, None), (None, None, 3, "", "")], "doc_id string, text string, h1 int, spans string, __key string")
    out = pii.redact(df)
    assert out.columns == df.columns and sorted((r.h1, r.text) for r in out.collect()) == [(1, "mail [EMAIL]"), (2, "mail [EMAIL]"), (3, None)]
    assert sorted(str(r.doc_id) for r in pii.report(df).collect()) == ["None", "x", "x"]
