"""Personal data: fixed formats as seeds, and identifiers that occur in the same words' company as the seeds do.

Bootstrapping: spans of the fixed formats (seeds) are instances; the words around an instance, one to three before and none
to two after, make its patterns. Texts are searched for whatever fills the slots of patterns that enough instances have,
one word or several, of any length and signs. Spark scores the graph of distinct (pattern, instance) edges: a pattern's
confidence for a kind is the share of its instances that are of that kind, an instance's score the chance that one of its
patterns is right. What is above a threshold is accepted, and makes patterns in turn, until a turn adds nothing. It becomes
spans of kind `like_<kind>`: instances that look like identifiers wherever they stand, ordinary words only in slots of
confident patterns.

A pattern with more fillers than its mass allows can't become confident, so a task stops gathering fillers of a pattern
once it alone has found too many; no pattern that could be confident is cut short.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Stages, unused
from .rows import ROW, row_hashes, typed

KINDS = ("email", "ip", "card", "phone")

# The formats of the contract. Each pattern scans a text of any shape in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")

#: Signs that don't belong to a candidate or a context word when they stand at its edge.
_EDGES = "\"'`()[]{}<>.,;:!?*#$%&|="
#: What looks like an identifier by itself; other instances are ordinary words outside of their slots.
_MARKED = re.compile(r"[@_\[\](){}]|[0-9](?:[^0-9]*[0-9]){2}")
_TOKEN = re.compile(r"\S+")
#: Patterns, and instances, that one scan of the texts looks for; more take more scans.
SCAN_WANTED = 200_000


@dataclass(frozen=True)
class Bootstrap:
    """The least confidence and mass of instances of a pattern that may vote; the least score to accept; and of how many
    words a filler consists at most, which is part of what a slot is: further words after it aren't its context."""

    min_confidence: float = 0.6
    min_mass: float = 3.0
    accept: float = 0.8
    max_words: int = 6


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0  # where the search goes on after a match
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_SIGNS:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            free = domain.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed formats, by kind as in KINDS, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _only_digits(m[0])) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_only_digits(m[0])) <= 15]
    return out


def _word(token: str) -> str:
    """The token as a context word: without edges, lower-cased, digits as 0; a digest of a long one."""
    bare = token.strip(_EDGES).lower()
    if not bare.isalpha():
        bare = _DIGITS.sub("0", bare)
    return bare if len(bare) <= 64 else hashlib.blake2b(bare.encode(), digest_size=16).hexdigest()


class Words:
    """The words of a text, and where they and their tokens begin and end. Tokens of edge signs alone are no words."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.words: list[str] = []
        self.tokens: list[tuple[int, int]] = []
        for m in _TOKEN.finditer(text):
            if word := _word(m[0]):
                self.words.append(word)
                self.tokens.append(m.span())

    def bare(self, i: int) -> tuple[int, int]:
        """Where word i stands without the edges of its token."""
        a, b = self.tokens[i]
        token = self.text[a:b].lstrip(_EDGES)
        return b - len(token), b - len(token) + len(token.rstrip(_EDGES))

    def around(self, start: int, end: int) -> list[str]:
        """The patterns of a span, which may begin and end within tokens."""
        before, after = [], []
        i = bisect_left(self.tokens, (start, start)) - 1
        if i >= 0 and self.tokens[i][1] > start:
            before += [w] if (w := _word(self.text[self.tokens[i][0] : start])) else []
            i -= 1
        before += self.words[max(0, i + 1 - (BEFORE - len(before))) : i + 1][::-1]
        j = bisect_left(self.tokens, (end, end))
        if j and self.tokens[j - 1][1] > end:
            after += [w] if (w := _word(self.text[end : self.tokens[j - 1][1]])) else []
        after += self.words[j : j + AFTER - len(after)]
        return _patterns(before[::-1], after)


class _Known(dict):
    """Token to word, of as many tokens as KNOWN."""

    def __missing__(self, token: str) -> str:
        word = _word(token)
        if len(self) < KNOWN and len(token) <= 64:
            self[token] = word
        return word


#: Tokens whose words a task remembers.
KNOWN = 100_000


#: Words of a pattern on either side at most.
BEFORE, AFTER = 3, 2


def _patterns(before: list[str], after: list[str]) -> list[str]:
    """Those with two words of context at least; the slot is the underscore."""
    out = [" ".join([*before[-n:], "_"]) for n in range(2, len(before) + 1)]
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
        if len(after) > 1:
            out.append(f"{before[-1]} _ {after[0]} {after[1]}")
        if len(before) > 1:
            out.append(f"{before[-2]} {before[-1]} _ {after[0]}")
    return out


class Wanted:
    """What a scan looks for: fillers of the slots of patterns, and instances wherever they stand."""

    def __init__(self, patterns: Iterable[str] = (), instances: Iterable[str] = (), max_words: int = Bootstrap.max_words) -> None:
        self.patterns, self.instances, self.max_words = frozenset(patterns), frozenset(instances), max_words
        self.first = frozenset(_word(m[0]) for i in self.instances if (m := _TOKEN.match(i)))
        #: By the word before the slot: the words before that one, and the words after the slot of patterns that have no such word.
        self.before: dict[str, tuple[set[str], set[str]]] = {}
        for pattern in self.patterns:
            left, right = pattern.split("_ ")[0].split(" ")[:-1] if "_ " in pattern else pattern.split(" ")[:-1], pattern.partition(" _ ")[2].split(" ")
            further, after = self.before.setdefault(left[-1], (set(), set()))
            if len(left) > 1:
                further.add(left[-2])
            else:
                after.add(right[0])

    def starts(self, words: list[str]) -> list[int]:
        """Numbers of the words that may begin what is wanted."""
        out = []
        last = second = None
        for i, word in enumerate(words):
            if found := self.before.get(last):
                further, after = found
                if second in further or after and not after.isdisjoint(words[i + 1 : i + 1 + self.max_words]):
                    out.append(i)
                elif word in self.first:
                    out.append(i)
            elif word in self.first:
                out.append(i)
            second, last = last, word
        return out


def candidates(text: str, wanted: Wanted = Wanted(), known: _Known | None = None) -> list[tuple[int, int, list[str]]]:
    """(start, end, wanted patterns around) of what is wanted and touches no base span, in text order.

    A slot with words on both sides is filled by the words between, the nearest words after it count. A slot without a
    word after it is filled by one word, or by the words from there that have digits.
    """
    known = _Known() if known is None else known
    words = [w for w in map(known.__getitem__, text.split()) if w]
    first = wanted.starts(words)
    out: list[tuple[int, int, list[str]]] = []
    if not first:
        return out
    own = Words(text)
    taken = sorted((a, b) for _, a, b in base_spans(text))
    starts = [a for a, _ in taken]
    reach = [0]
    for _, b in taken:
        reach.append(max(reach[-1], b))

    def free(a: int, b: int) -> bool:
        return reach[bisect_right(starts, b - 1)] <= a

    for i in first:
        a = own.bare(i)[0]
        before = words[max(0, i - BEFORE) : i]
        run = i  # the last of the words with digits from here on
        last = min(len(words), i + wanted.max_words)
        while run + 1 < last and "0" in words[run] and "0" in words[run + 1] and free(a, own.bare(run + 1)[1]):
            run += 1
        filled: set[str] = set()
        for j in range(i, last):
            b = own.bare(j)[1]
            if not free(a, b):
                break
            around = _patterns(before, words[j + 1 : j + 1 + AFTER])
            found = [p for p in around if p in wanted.patterns and p not in filled and (j == run or not p.endswith("_"))]
            if found or text[a:b] in wanted.instances:
                out.append((a, b, found))
                filled.update(found)
    return out


def joined(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


_SCANNED = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, instances array<struct<kind: string, instance: string, patterns: array<string>>>"
_ARROW_INSTANCE = pa.struct([("kind", pa.string()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, list[int]] = {k: [] for k in KINDS}
        bases, digests, found = [], [], []
        for value in batch.column("text"):
            text = value.as_py() or ""
            base = base_spans(text)
            for kind in KINDS:
                counts[kind].append(sum(k == kind for k, _, _ in base))
            bases.append(joined(base))
            digests.append(hashlib.sha256(bases[-1].encode()).hexdigest())
            own = Words(text) if base else None
            found.append([{"kind": k, "instance": text[a:b], "patterns": own.around(a, b)} for k, a, b in base])
        made = [*(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(bases, pa.string()), pa.array(found, pa.list_(_ARROW_INSTANCE))]
        kept = ["doc_id", *ROW]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *made], names=[*kept, *(f"n_{k}" for k in KINDS), "base_sha256", "base", "instances"])


def _or_of(confidence: Column) -> Column:
    """The chance that one at least is right."""
    return 1 - F.exp(F.sum(F.log(F.greatest(1 - confidence, F.lit(1e-9)))))


#: Fillers that a task holds at most, by their signs, before it passes them on.
HELD_SIGNS = 4 << 20


def _filled(shared):
    """Distinct (pattern, instance) of a task; instance null of a pattern that has more than its limit."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, limits = shared.value
        known = _Known()
        held: dict[str, set[str]] = {}
        over: set[str] = set()
        size = 0

        def block() -> pa.RecordBatch:
            pairs = [(p, i) for p, own in held.items() for i in own]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in pairs], pa.string()) for k in (0, 1)], names=["pattern", "instance"])

        for batch in batches:
            for value in batch.column("text"):
                text = value.as_py() or ""
                for a, b, found in candidates(text, wanted, known):
                    for pattern in found:
                        if pattern in over:
                            continue
                        own = held.setdefault(pattern, set())
                        if (filler := text[a:b]) not in own:
                            own.add(filler)
                            size += b - a + 64
                        if len(own) > limits[pattern]:
                            over.add(pattern)
                            del held[pattern]
                if size > HELD_SIGNS:
                    yield block()
                    size = 0
                if 10 * len(over & wanted.patterns) > len(wanted.patterns):  # the task needn't look for these any more
                    wanted = Wanted(wanted.patterns - over, max_words=wanted.max_words)
        yield block()
        yield pa.RecordBatch.from_arrays([pa.array(sorted(over), pa.string()), pa.array([None] * len(over), pa.string())], names=["pattern", "instance"])

    return run


def _searched(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known()
        for batch in batches:
            rows, made = [], []
            for at, value in enumerate(batch.column("text")):
                text = value.as_py() or ""
                if found := candidates(text, shared.value, known):
                    own = Words(text)
                    made += [(a, b, text[a:b], own.around(a, b), patterns) for a, b, patterns in found]
                    rows += [at] * len(found)
            columns = list(zip(*made)) or [()] * 5
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
            kept = batch.select(list(ROW)).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[*ROW, "start", "end", "instance", "around", "found"])

    return run


_OCCURRENCE = "h1 long, h2 long, h3 long, start int, end int, instance string, around array<string>, found array<string>"


def _parts(tables: list[DataFrame], most: int) -> Iterator[list[list]]:
    """The rows of each table in parts of a bounded size; a value is in the same part of all."""
    scans = -(-most // SCAN_WANTED)
    for scan in range(scans):
        yield [df.filter(F.pmod(F.xxhash64(df.columns[0]), F.lit(scans)) == scan).collect() for df in tables]


def _fillers(rows: DataFrame, patterns: DataFrame, most: int, accepted: int, how: Bootstrap) -> DataFrame:
    """(pattern, instance) of the slots of patterns (pattern, seeds). So many fillers let none be confident, whichever are accepted."""
    spark = rows.sparkSession
    found = spark.createDataFrame([], "pattern string, instance string")
    for (own,) in _parts([patterns], most):
        limits = {r["pattern"]: math.ceil((r["seeds"] + accepted) / how.min_confidence) + accepted for r in own}
        shared = spark.sparkContext.broadcast((Wanted(limits, max_words=how.max_words), limits))
        found = found.unionByName(rows.select("text").mapInArrow(_filled(shared), "pattern string, instance string"))
    return found


def _occurrences(rows: DataFrame, patterns: DataFrame, instances: DataFrame, most: int, how: Bootstrap) -> DataFrame:
    """Where the patterns' slots are filled and the instances stand."""
    spark = rows.sparkSession
    found = spark.createDataFrame([], _OCCURRENCE)
    for own in _parts([patterns, instances], most):
        shared = spark.sparkContext.broadcast(Wanted(*([r[0] for r in part] for part in own), max_words=how.max_words))
        found = found.unionByName(rows.select(*ROW, "text").mapInArrow(_searched(shared), _OCCURRENCE))
    return found


def _accepted(rows: DataFrame, edges: DataFrame, how: Bootstrap, stages: Stages) -> DataFrame:
    """(h1, h2, h3, start, end, kind) of what the patterns vouch for. edges: (pattern, instance, kind) of the seeds."""
    seeds = stages.write(edges.groupBy("instance").agg(F.max("kind").alias("kind")).withColumn("score", F.lit(1.0)), "seeds")
    known = edges.select("pattern", "instance").distinct()
    accepted = stages.write(seeds.filter("false"), "accepted")
    spans = rows.sparkSession.createDataFrame([], "h1 long, h2 long, h3 long, start int, end int, kind string")

    def worth(of: DataFrame) -> DataFrame:
        return of.groupBy("pattern", "kind").agg(F.sum("score").alias("mass")).filter(F.col("mass") >= how.min_mass)

    seeded = known.groupBy("pattern").agg(F.count(F.lit(1)).alias("seeds"))
    patterns = stages.write(worth(known.join(seeds, "instance")).select("pattern").distinct().join(seeded, "pattern"), "patterns")
    n_patterns, n_accepted, turn = patterns.count(), 0, 0
    while n_patterns:
        filled = stages.write(_fillers(rows, patterns, n_patterns, n_accepted, how).distinct(), f"filled-{turn}")
        over = filled.filter("instance is null").select("pattern").distinct()
        loose = filled.filter("instance is not null").join(over, "pattern", "left_anti").join(seeds.select("instance"), "instance", "left_anti").select("pattern", "instance")
        loose = stages.write(loose, f"loose-{turn}")
        graph = known.join(patterns.select("pattern").join(over, "pattern", "left_anti"), "pattern", "left_semi").unionByName(loose)
        sizes = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("size"))
        mass = worth(graph.join(seeds.unionByName(accepted), "instance"))
        sure = mass.join(sizes, "pattern").withColumn("confidence", F.col("mass") / (F.col("size") + 1)).filter(F.col("confidence") >= how.min_confidence)
        sure = stages.write(sure.select("pattern", "kind", "confidence"), f"sure-{turn}")
        votes = loose.join(sure, "pattern").groupBy("instance", "kind").agg(_or_of(F.col("confidence")).alias("score"))
        best = votes.filter(F.col("score") >= how.accept).groupBy("instance").agg(F.max(F.struct("score", "kind")).alias("best")).select("instance", "best.kind", "best.score")
        accepted = stages.write(best.unionByName(accepted.join(best, "instance", "left_anti")), f"accepted-{turn}")
        n_sure, n_all = sure.select("pattern").distinct().count(), accepted.count()
        if not n_all:
            break
        marked = accepted.filter(F.col("instance").rlike(_MARKED.pattern)).select("instance")
        there = stages.write(_occurrences(rows, sure.select("pattern").distinct(), marked, max(n_sure, n_all), how), f"there-{turn}")
        own = there.join(accepted, "instance")
        placed = own.withColumn("pattern", F.explode("found")).join(sure.select("pattern", "kind"), ["pattern", "kind"], "left_semi").drop("pattern")
        own = stages.write(own.filter(F.col("instance").rlike(_MARKED.pattern)).unionByName(placed.select(own.columns)), f"own-{turn}")
        spans = own.select(*ROW, "start", "end", "kind").distinct()
        fresh = own.select(F.explode("around").alias("pattern"), "instance", "kind", "score").distinct()
        more = worth(fresh.unionByName(known.join(seeds, "instance").select(fresh.columns))).select("pattern")
        more = patterns.select("pattern").unionByName(more).distinct().join(seeded, "pattern", "left").withColumn("seeds", F.coalesce("seeds", F.lit(0)))
        patterns = stages.write(more, f"patterns-{turn}")
        counts = patterns.count(), n_all
        if counts == (n_patterns, n_accepted):
            break
        n_patterns, n_accepted = counts
        turn += 1
    return spans


def find(df: DataFrame, how: Bootstrap | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(scanned, found): a row for each row of df with its base spans, and one for each id and text that has spans of the method.

    scanned: doc_id, h1, h2, h3, n_email, n_ip, n_card, n_phone, base_sha256, base. found: h1, h2, h3, spans. The hashes tell
    ids and texts apart. A null text is empty: no spans. Null and repeated ids, of any type, are kept, each row by itself.
    An empty table gives empty tables.
    """
    how = how or Bootstrap()
    stages = Stages(df.sparkSession, "pii")
    rows = df.select(df[id_col].alias("doc_id"), *(c.alias(n) for c, n in zip(row_hashes(df[id_col], df[text_col]), ROW)), df[text_col].alias("text"))
    scanned = stages.write(rows.mapInArrow(_scan, typed(rows, ["doc_id", *ROW], _SCANNED)), "scanned")
    each = scanned.select(F.explode("instances").alias("x")).select("x.*")
    edges = each.select("kind", "instance", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))
    spans = _accepted(rows, stages.write(edges, "edges"), how, stages)
    span = F.struct(F.concat(F.lit("like_"), F.col("kind")).alias("kind"), "start", "end")
    found = spans.groupBy(*ROW).agg(F.array_sort(F.collect_list(span)).alias("spans"))
    return scanned.drop("instances"), stages.write(found, "found")


def report(df: DataFrame, how: Bootstrap | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found of every row of df; see `find` for the edge cases.

    spans are base ones by kind as in KINDS, then those of the method by kind; within a kind by start.
    """
    scanned, found = find(df, how, id_col, text_col)
    more = F.transform("more", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.size("more") > 0, F.array_join(more, ",")))
    out = scanned.join(found.withColumnRenamed("spans", "more"), list(ROW), "left")
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"), F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_found"))


def redacted(text: str, extra: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of spans that overlap the first, then longest, stands."""
    out, done = [], 0
    for a, b, kind in sorted(((a, b, k) for k, a, b in [*base_spans(text), *extra]), key=lambda s: (s[0], -s[1])):
        if a >= done:
            out += [text[done:a], f"[{kind.removeprefix('like_').upper()}]"]
            done = b
        elif b > done:  # what an overlapping span adds goes as well
            done = b
    return "".join([*out, text[done:]])


#: Found spans up to this number of rows are sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 50_000


def redact(df: DataFrame, how: Bootstrap | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df, all its columns, with personal data in text_col replaced; a null text stays null. Rows and their number stay."""
    _, found = find(df, how, id_col, text_col)
    *hashes, more = unused([*ROW, "spans"], df.columns)
    found = found.withColumnsRenamed(dict(zip([*ROW, "spans"], [*hashes, more])))
    if found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    rows = df.withColumns(dict(zip(hashes, row_hashes(df[id_col], df[text_col])))).join(found, hashes, "left").select(*(F.col(f"`{n}`") for n in df.columns), more)
    names = df.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            extra = [[(s["kind"], s["start"], s["end"]) for s in spans or []] for spans in batch.column(more).to_pylist()]
            texts = [None if (t := value.as_py()) is None else redacted(t, own) for value, own in zip(batch.column(text_col), extra)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == text_col else batch.column(n) for n in names], names=names)

    return rows.mapInArrow(run, df.schema)
