"""Operators against plain forms of their own methods, and what odd rows give, by value."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, chat, langid, mixing, quality, simhash, suffixdedup, topk, util
from tidemark.llm.queries import ORACLES
from tidemark.llm.util import read

SF = "/root/testdata/sf0.01"


class PlainKneserNey:
    """Interpolated Kneser-Ney over strings, from the formulas, for one language."""

    def __init__(self, words: dict[str, int]):
        n = langid.ORDER
        self.count = [Counter() for _ in range(n + 1)]  # by order: n-gram strings
        lines = {chr(langid.START) * (n - 1) + w + chr(langid.END): c for w, c in words.items()}
        for line, c in lines.items():
            for i in range(n - 1, len(line)):
                self.count[n][line[i - n + 1 : i + 1]] += c
        for order in range(n - 1, 0, -1):
            # Below the top order: of how many different symbols a gram follows.
            seen = {line[i - order : i + 1] for line in lines for i in range(n - 1, len(line))}
            self.count[order] = Counter(g[1:] for g in seen)
        self.discount, self.whole, self.kinds = {}, {}, {}
        for order in range(1, n + 1):
            values = Counter(self.count[order].values())
            one, two = values[1], values[2]
            self.discount[order] = one / (one + 2 * two) if one and two else 0.75
            self.whole[order], self.kinds[order] = Counter(), Counter()
            for gram, c in self.count[order].items():
                self.whole[order][gram[:-1]] += c
                self.kinds[order][gram[:-1]] += 1

    def chance(self, gram: str, floor: float) -> float:
        order = len(gram)
        if not order:
            return floor
        lower = self.chance(gram[1:], floor)
        context = gram[:-1]
        if not self.whole[order][context]:
            return lower
        own = max(self.count[order][gram] - self.discount[order], 0) / self.whole[order][context]
        return own + self.discount[order] * self.kinds[order][context] / self.whole[order][context] * lower

    def score(self, word: str, floor: float) -> float:
        n = langid.ORDER
        line = chr(langid.START) * (n - 1) + word + chr(langid.END)
        return sum(math.log(self.chance(line[i - n + 1 : i + 1], floor)) for i in range(n - 1, len(line)))


def test_language_models_are_kneser_ney():
    rng = random.Random(21)
    vocabulary = {x: ["".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(300)] for x, letters in {"a": "abcde", "b": "bcdefg", "c": "éèaxyz"}.items()}
    counts = {x: Counter(rng.choices(words, k=900)) for x, words in vocabulary.items()}
    model = langid.train({x: ([*c], np.array([*c.values()])) for x, c in counts.items()})
    plain = {x: PlainKneserNey(c) for x, c in counts.items()}
    floor = math.exp(model.floor)
    symbols = {s for c in counts.values() for w in c for s in w} | {chr(langid.END)}
    assert abs(floor - 1 / (len(symbols) + 1)) < 1e-12
    words = [*{w for v in vocabulary.values() for w in v[:40]}, "zzzq", "q", "abx", "èè"]
    found, _ = model.score(words)
    for k, x in enumerate(model.languages):
        wanted = np.array([plain[x].score(w, floor) for w in words])
        assert np.allclose(found[:, k], wanted, rtol=1e-4, atol=1e-3)


def test_languages_are_those_of_the_plain_models(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    taken = langid.sample(docs).where("NOT calibrates").collect()
    words = {x: Counter(w for r in taken if r.lang == x for w in langid.LETTERS.findall(r.text.lower())) for x in model.languages}
    plain = {x: PlainKneserNey(c) for x, c in words.items()}
    found = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for key in sorted(texts)[:25]:
        seen = langid.LETTERS.findall((texts[key] or "").lower())[:400]
        part = " ".join(seen)
        memory = langid.Memory(model)
        total, n = memory.texts([part])
        if not n[0]:
            assert found[key].lang_pred == "und"
            continue
        wanted = np.array([sum(plain[x].score(w, math.exp(model.floor)) * c for w, c in Counter(seen).items()) for x in model.languages])
        assert np.allclose(total[0], wanted, rtol=1e-4) and total[0].argmax() == wanted.argmax()


def test_the_sample_is_the_first_keys_by_hash(spark):
    rows = [(k % 3000, f"t{k}", "en" if k % 50 else "fr") for k in range(6000)] + [(9, "a repeated row", "en")] * 500 + [(None, "x", "en"), (1, None, "en"), (2, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    found = langid.sample(docs, 100).collect()
    keys = docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).distinct().collect()
    for lang in ("en", "fr"):
        wanted = sorted((r.h, r.doc_id) for r in keys if r.lang == lang)[:100]
        assert sorted(r.doc_id for r in found if r.lang == lang) == sorted(k for _, k in wanted)


def test_quality_is_the_plain_vote(spark):
    docs, labels = read(spark, "/root/testdata/sf0.001", "documents"), read(spark, "/root/testdata/sf0.001", "labels")
    voters = quality.fit(docs, labels)
    scores = {r.doc_id: r.score for r in quality.score(docs, voters).collect()}
    shapes = quality.Shapes()
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    rows = np.stack([quality.terms(texts[k], shapes) for k in sorted(known)])
    weights = np.log((1 + len(rows)) / (1 + (rows > 0).sum(0))) + 1
    _, size, right = np.linalg.svd(rows * weights, full_matrices=False)
    axes = right[: quality.DIMENSIONS][size[: quality.DIMENSIONS] ** 2 > 1e-9].T
    place = lambda x: (lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) > 1e-12 else v * 0)((x * weights) @ axes)
    voting = [(place(x), known[k]) for k, x in zip(sorted(known), rows)]
    for key, text in texts.items():
        own = place(quality.terms(text, shapes))
        near = sorted(((float(own @ v), q) for v, q in voting), reverse=True)
        last = near[min(quality.NEIGHBOURS, len(near)) - 1][0]
        votes = [(max(s, 0) ** quality.SHARPNESS, q) for s, q in near if s >= last - 1e-9]
        total = sum(w for w, _ in votes)
        wanted = sum(w * q for w, q in votes) / total if total else np.mean([*known.values()])
        assert abs(scores[key] - wanted) < 1e-6


def test_tied_neighbours_all_vote():
    x = np.eye(3)
    voters = quality.Voters(np.ones(3), np.eye(3), np.repeat(x[:1], 60, 0), np.array([1.0] * 15 + [0.0] * 45), 0.25)
    assert voters.score(x[:1])[0] == 0.25 and voters.score(x[1:2])[0] == 0.25


def unit(rng, n, d, centres=0):
    x = rng.normal(size=(n, d))
    if centres:
        x = 0.6 * x + rng.normal(size=(centres, d))[rng.integers(0, centres, n)]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_recall_with_a_second_turn(spark, monkeypatch):
    """Buckets made small, so that the second turn splits them; recall stays above 0.9."""
    monkeypatch.setattr(ann, "BUCKET", 8)
    monkeypatch.setattr(ann, "LOOK", 256)
    x = unit(np.random.default_rng(3), 12_000, 32, centres=40)
    assert ann.shape(*x.shape)[0] > 0
    table = spark.createDataFrame([(int(k), v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(6)
    found = defaultdict(set)
    for r in ann.op5(table).collect():
        found[r.query_id].add(r.vec_id)
    hit = 0
    for q in range(0, len(x), 100):
        near = ((x - x[q]) ** 2).sum(1)
        near[q] = np.inf
        hit += len({*np.argsort(near, kind="stable")[:10].tolist()} & found[q])
    assert hit / (10 * len(found)) >= 0.9 and len(found) == 120


@pytest.mark.parametrize("copies", [1, 60])
def test_few_pairs_reach_the_vectors(spark, monkeypatch, copies):
    """What a query hands on follows its answers, neither the buckets it looks into nor the copies of what is there."""
    monkeypatch.setattr(ann, "BUCKET", 8)
    monkeypatch.setattr(ann, "LOOK", 256)
    x = np.tile(unit(np.random.default_rng(6), 6000 // copies, 32), (copies, 1))
    counted, real = [], ann._measured
    monkeypatch.setattr(ann, "_measured", lambda rows, queries, maybe, k: counted.append(maybe.count()) or real(rows, queries, maybe, k))
    table = spark.createDataFrame([(int(k), v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(6)
    found = defaultdict(list)
    for r in ann.op5(table).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    hit = 0
    for q in range(0, len(x), 100):
        near = ((x - x[q]) ** 2).sum(1)
        near[q] = np.inf
        exact = np.argsort(near, kind="stable")[:10].tolist()
        assert copies == 1 or found[q] == exact
        hit += len({*exact} & {*found[q]})
    assert hit >= 0.9 * 10 * len(found) and len(found) == 60
    assert counted[0] <= 60 * 10 * 40


def test_codes_say_how_far_off_they_are():
    x = unit(np.random.default_rng(4), 200, 48) * np.logspace(-100, 100, 200)[:, None]
    codes, step, off = ann.coded(x)
    assert (np.linalg.norm(codes * step[:, None] - x, axis=1) <= off).all() and (off < 0.05 * np.linalg.norm(x, axis=1)).all()


@pytest.mark.parametrize("centres", [0, 20])
def test_topk_stops_on_proof(centres):
    """Most queries close before all postings are met, and no member is lost."""
    x = unit(np.random.default_rng(5), 4000, 64, centres)
    block, met = topk.Block(np.arange(len(x)), x), topk.Met()
    values = np.floor(64 * x).astype(int)
    for q in range(0, 400, 20):
        ids, scores = block.top(q, x[q], 20, -np.inf, met)
        exact = sorted((-int(values[q] @ v), k) for k, v in enumerate(values) if k != q)[:20]
        assert [*zip((-scores).tolist(), ids.tolist())] == exact
    assert sum(met.closed) == 20 and met.to_the_end == 0 and met.members < 0.1 * 20 * len(x)
    least = topk.Met()
    for q in range(0, 400, 20):
        _, scores = block.top(q, x[q], 20, -np.inf, topk.Met())
        ids, again = block.top(q, x[q], 20, float(scores[-1]), least)
        assert (again == scores).all()
    rounds = lambda m: sum(k * n for k, n in enumerate(m.closed))
    assert rounds(least) <= rounds(met) and sum(least.closed) == 20


def test_topk_of_huge_components(spark):
    rows = [(0, [2.0**40, 1.0, -3.5]), (20, [2.0**20, 2.0**20, 0.25]), (1, [2.0**12, 5.0, 1.0]), (2, [-(2.0**30), 7.0, 1.0]), (3, [2.0**52, 0.0, 1.0]), (4, [2.0**52, 1.0, 1.0]), (5, [1e308, 1.0, 1.0]), (5, [0.0, 1.0, 1.0])]
    found = {(r.query_id, r.vec_id): r.score for r in topk.op7(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    whole = lambda v: [math.floor(64 * x) if abs(x) < 1e300 else 64 * int(x) for x in v]
    for key, asked in rows[:2]:
        best = {}
        for other, v in rows:
            if other != key:
                score = sum(a * b for a, b in zip(whole(asked), whole(v)))
                best[other] = max(best.get(other, -(1 << 63)), min(max(score, -(1 << 63)), (1 << 63) - 1))
        assert {o: found[key, o] for o in best} == best


def test_blocks_share_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 200)
    x = unit(np.random.default_rng(6), 1000, 16)
    rows = [(int(k), v.tolist()) for k, v in enumerate(x)] + [(7, x[7].tolist())] * 30
    values = np.floor(64 * x).astype(int)
    found = defaultdict(list)
    for r in topk.op7(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect():
        found[r.query_id].append((r["rank"], -r.score, r.vec_id))
    for q in range(0, 1000, 20):
        exact = sorted((-int(values[q] @ v), k) for k, v in enumerate(values) if k != q)[:20]
        assert sorted(found[q]) == [(n, s, k) for n, (s, k) in enumerate(exact, 1)]


def test_ordinary_text_goes_up_the_tree(spark, monkeypatch):
    joins, leaves = [], []
    real, leaf = bpe.Codec.join, bpe.Codec.leaf
    monkeypatch.setattr(bpe.Codec, "join", lambda self, a, b: joins.append(1) or real(self, a, b))
    monkeypatch.setattr(bpe.Codec, "leaf", lambda self, x: leaves.append(len(x)) or leaf(self, x))
    codec = bpe.Codec(*bpe.vocabulary())
    import public_tokenizers
    import tiktoken

    plain = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    texts = [r.text for r in read(spark, "/root/testdata/sf0.001", "documents").collect() if r.text]
    for text in texts:
        ids = codec.encode(text)
        assert ids == plain.encode_ordinary(text) and codec.decode(ids) == text.encode()
    assert len(joins) > 1000 and max(leaves) <= bpe.LEAF


def test_decoding_is_a_tree(monkeypatch):
    codec = bpe.codec(*bpe.vocabulary())
    ids = codec.encode("the quick brown fox, été 中文 " * 200)
    whole = codec.decode(ids)
    for run in (1, 2, 7):
        monkeypatch.setattr(bpe, "RUN", run)
        assert codec.decode(ids) == whole and codec.decode(ids[:1]) == codec.bytes_of[ids[0]] and codec.decode([]) == b""


def test_hot_keys_meet_again(spark, monkeypatch):
    """Thousands of fingerprints around a few centres, with runs far above HOT: the same components as all pairs."""
    rng = random.Random(8)
    prints = {sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) ^ c for c in (0, (1 << 40) - 1) for _ in range(350)} | {rng.getrandbits(64) for _ in range(50)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(3)
    root = {p: p for p in signed}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[i + 1 :]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4:
                root[find(a)] = find(b)
    want = {frozenset(x for x in signed if find(x) == r) for r in {find(x) for x in signed}}
    for hot in (1 << 16, 40, 3):
        monkeypatch.setattr(simhash, "HOT", hot)
        root = {p: p for p in signed}
        for r in simhash.links(frame).collect():
            root[find(r.a)] = find(r.b)
        assert {frozenset(x for x in signed if find(x) == r) for r in {find(x) for x in signed}} == want


def test_a_mix_is_exact_along_long_lines(spark):
    """At rate 2 every document is taken exactly twice, whatever the offset and however far along the line."""
    rows = spark.range(300_000).select(F.col("id").alias("rid"), F.when(F.col("id") % 7 != 0, F.col("id")).alias("doc_id"), F.lit("s").alias("source"), F.lit(3).cast("long").alias("size"))
    found = mixing.plan(rows, share=5.0)
    assert {r.copies for r in found.select("copies").distinct().collect()} == {2}
    old = mixing.RANGE
    try:
        mixing.RANGE = 1000  # many ranges: the same line
        half = lambda: {r.rid: r.copies for r in mixing.plan(rows, share=0.75).collect()}
        cut = half()
    finally:
        mixing.RANGE = old
    assert cut == {r.rid: r.copies for r in mixing.plan(rows, share=0.75).collect()} and sum(cut.values()) in (224_999, 225_000, 225_001)


def test_a_chat_ends_as_its_log(spark):
    events = [
        (1, 1, 0, "message", "user", "dr"), (1, 1, 1, "edit", None, "asked"), (1, 2, 2, "message", "assistant", "wrong"), (1, 2, 3, "delta", None, "er"), (1, 2, 4, "regenerate", None, None),
        (1, 2, 5, "delta", None, "right "), (1, 2, 6, "delta", None, "one</s>"), (1, 3, 7, "message", None, None), (2, 1, 0, "delta", "user", "no opening"), (2, 1, 1, "edit", None, ""),
    ]
    frame = spark.createDataFrame(events, "conv_id long, message_id long, seq long, kind string, role string, text string").withColumns({c: F.lit(1) for c in ("n", "part", "said", "turn", "at", "pieces", "formatted")})
    found = {r.conv_id: r for r in chat.parse(chat.render(chat.fold(frame.repartition(3)))).collect()}
    assert [tuple(t) for t in found[1].turns] == [("user", "asked"), ("assistant", "right one</s>"), ("", "")] and found[1].loss == "right one</s>"
    assert [tuple(t) for t in found[2].turns] == [("user", "")] and found[2].loss == ""


def test_chats_of_the_table_come_from_whole_logs(spark):
    table = read(spark, SF, "conversations")
    log = chat.from_table(table)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"message", "delta", "regenerate"} | ({"edit"} if table.where("role NOT IN ('user', 'assistant')").count() else set())
    rng = random.Random(3)
    long = "".join(rng.choice(["word ", "</s>", "[INST]", "é"]) for _ in range(200_000))
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 1, "assistant", long), (1, 1, None, "x"), (1, 1, "system", None), (None, 0, "user", "a"), (2, None, "assistant", ""), (2, None, "assistant", None)]
    odd = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({c: F.lit(1) for c in ("n", "part", "message_id", "seq", "kind", "events", "e")})
    found = {r.conv_id: r for r in chat.op4(odd.repartition(3)).collect()}
    assert set(found) == {1, 2, None, -1} and found[1].n_turns == 5 and found[1].loss_chars == 2 * len(long) and found[2].n_turns == 2
    turns = [("user", long), ("assistant", long), ("assistant", long), ("system", ""), ("", "x")]
    assert found[1].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert [r.conv_id for r in chat.op4(odd.limit(0)).collect()] == [-1] and "op4_chat_formatting" in ORACLES


LABELS = "doc_id long, quality int, toxic int"


def test_odd_rows_by_value(spark):
    """What null, empty, wordless and repeated rows give, operator by operator."""
    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (3, " \n", None, None), (4, "123 !", "en", "s"), (4, "123 !", "en", "s"), (None, "some words here", "en", None), (5, "some words here", "en", "s"), (6, "more words in here", "en", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(1) for c in ("rid", "row", "kept", "score", "key")}).repartition(3)
    empty = hashlib.sha256(b"").hexdigest()
    one = {r.doc_id: (r.lang_pred, r.score) for r in langid.op1(docs).collect() if r.doc_id in (1, 2, 3, 4)}
    assert one == dict.fromkeys((1, 2, 3, 4), ("und", 0.0))
    two = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op2(docs).collect()}
    assert two[1] == two[2] == two[3] == ("0" * 16, 1) and two[None] == two[5] and two[5][1] == 5
    three = {r.doc_id: r for r in bpe.op3(docs).collect()}
    assert all((three[k].n_tokens, three[k].ids_sha256, three[k].decoded_sha256) == (0, empty, empty) for k in (1, 2)) and three[3].n_tokens > 0
    eight = {r.doc_id: r for r in quality.op8(docs, spark.createDataFrame([(5, 1, 0), (6, 0, 0), (4, 0, 0)], LABELS)).collect()}
    assert eight[1].score == eight[2].score == eight[3].score and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in eight.values())
    none = {r.score for r in quality.op8(docs, spark.createDataFrame([], LABELS)).collect()}
    assert none == {0.5}
    nine = {r.doc_id: r for r in suffixdedup.op9(docs).collect()}
    assert (nine[1].n_bytes, nine[1].n_removed, nine[1].n_spans, nine[1].kept_sha256, nine[1].n_passages) == (0, 0, 0, empty, 0) and nine[4].n_bytes == 5
    ten = [r for r in mixing.op10(docs).collect()]
    assert {r.size for r in ten if r.doc_id in (1, 2, 3)} == {0} and {r.taken for r in ten if r.size == 0} == {0} and sum(r.doc_id == 4 for r in ten) == 2
    assert {r.source_size for r in ten if r.doc_id is None} == {3}


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://elsewhere:7077"

        class _jsc:
            @staticmethod
            def sc():
                class Unset:
                    @staticmethod
                    def getCheckpointDir():
                        class Option:
                            @staticmethod
                            def isDefined():
                                return False

                        return Option

                return Unset

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        util.shared_dir(Session)


def test_classes_find_what_pairs_find():
    """Large groups are resolved by classes, small ones by pairs: the same spans, by either measure."""
    rng = random.Random(31)
    for low, measure in enumerate(suffixdedup.MEASURES):
        symbol = lambda: bytes(rng.randrange(3) for _ in range(measure.wide))  # noqa: B023, E731
        core = b"".join(symbol() for _ in range(measure.length + 15))
        gram = measure.wide * (measure.length // 2)
        group = []
        for k in range(30):
            left = core[: gram][rng.randrange(0, gram // measure.wide) * measure.wide :]
            right = core[gram : rng.randrange(gram + measure.reach, len(core)) // measure.wide * measure.wide]
            group.append((right + b"".join(symbol() for _ in range(rng.randrange(5))), left, 2 * k + low, 1000, False))
        group.sort()
        shared = [0] + [suffixdedup.common(a[0], b[0]) for a, b in zip(group, group[1:])]
        shared = [s // measure.wide for s in shared]
        one, two = ({i: [] for i in range(30)} for _ in range(2))
        for out, of in ((one, suffixdedup._pairs), (two, suffixdedup._classes)):
            for i, a, b in of(group, shared, measure.length):
                out[i] += range(a, b + 1)
        assert {i: set(x) for i, x in one.items()} == {i: set(x) for i, x in two.items()}


def test_a_character_goes_when_a_byte_of_it_goes(spark):
    """The two first characters end in the same byte, so the repeated string begins inside them."""
    rng = random.Random(9)
    tail = "".join(rng.choice("abcdefgh") for _ in range(399))
    assert "é".encode()[-1] == "ĩ".encode()[-1]
    docs = spark.createDataFrame([(1, "xé" + tail), (2, "yĩ" + tail), (3, None), (4, "é" + tail[:397])], "doc_id long, text string")
    kept = {r.doc_id: r.text for r in suffixdedup.remove_repeats(docs).collect()}
    assert kept == {1: "x", 2: "y", 3: None, 4: "é" + tail[:397]}
    counts = {r.doc_id: (r.n_removed, r.n_spans) for r in suffixdedup.op9(docs).collect()}
    assert counts == {1: (400, 1), 2: (400, 1), 3: (0, 0), 4: (0, 0)}
