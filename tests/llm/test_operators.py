"""Each operator against brute force on small inputs, and on odd ones."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, chat, graph, langid, licenses, mixing, quality, simhash, suffixdedup, topk
from tidemark.llm.queries import QUERIES
from tidemark.llm.util import read

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("rid", "row", "fp", "key", "size", "copies", "class", "bin", "words", "parts", "at", "template", "score", "vector", "spans", "kept", "_text", "root", "target", "place")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, very long and repeated texts, repeated rows and keys, clashing names."""
    rng = random.Random(1)
    long = " ".join(rng.choice(["alpha", "beta", "Gamma!", "été", "中文", "1"]) for _ in range(60000))
    texts = [None, "", " ", "\n\t", "one", "a b c", "A B C", long, long, "x" * 30000, "=" * 5000, "released under the MIT license. " * 5, "\U0001f600 é", "the the the the the"]
    rows = [(k, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", None]), 1) for k, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "no key", "en", "s1", None), (None, None, None, None, None), (-5, "one", "en", "", 3)]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(7) for c in CLASHING}).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


LABELS = "doc_id long, quality int, toxic int"
OPERATORS = {
    "op1": lambda s, d: langid.op1(d), "op2": lambda s, d: simhash.op2(d), "op3": lambda s, d: bpe.op3(d), "op6": lambda s, d: licenses.op6(d),
    "op8": lambda s, d: quality.op8(d, s.createDataFrame([(4, 1, 0), (5, 0, 0), (5, None, None), (None, 1, 1)], LABELS)),
    "op9": lambda s, d: suffixdedup.op9(d), "op10": lambda s, d: mixing.op10(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, odd, none, name):
    found = OPERATORS[name](spark, odd).collect()
    keys = lambda rows: Counter(r.doc_id for r in rows)
    assert keys(found) == keys(odd.collect())
    assert OPERATORS[name](spark, none).collect() == []


STAGES = {
    "quality": lambda s, d: quality.keep_good(d, s.createDataFrame([(4, 1, 0), (7, 0, 0)], LABELS)), "near": lambda s, d: simhash.first_of_each(d),
    "repeats": lambda s, d: suffixdedup.remove_repeats(d), "mix": lambda s, d: mixing.mix(d), "tokens": lambda s, d: bpe.encode(d),
}


@pytest.mark.parametrize("name", STAGES)
def test_odd_stages(spark, odd, none, name):
    found = STAGES[name](spark, odd)
    assert found.columns[: len(odd.columns)] == odd.columns
    found.collect()
    assert STAGES[name](spark, none).collect() == []


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(150)] + [(5000, 5000 + k) for k in range(1, 80)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    found = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {(r.node, r.root) for r in found} == {(x, find(x)) for x in root}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    rng = random.Random(2)
    base = [[rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(120)] for _ in range(5)]
    rows = []
    for k in range(250):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(120)] = "zz"
        rows.append((k, " ".join(words) if k % 9 else rng.choice([None, "", "A b", "a B c d"])))
    found = {r.doc_id: r for r in simhash.op2(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = {k: plain_fingerprint(t) for k, t in rows}
    assert {k: int(r.fingerprint, 16) for k, r in found.items()} == prints
    seen, least = {}, {}
    for k in sorted(prints):
        if k in seen:
            continue
        todo = [k]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen[x] = k
                todo += [y for y in prints if y not in seen and (prints[x] ^ prints[y]).bit_count() <= 4]
        least[k] = k
    assert {k: r.component_id for k, r in found.items()} == seen
    kept = simhash.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(least)


def test_long_runs_link_alike():
    rng = np.random.default_rng(3)
    values = np.unique(np.concatenate([np.uint64(0xABCDEF) ^ (np.uint64(1) << rng.integers(0, 64, 400, np.uint64)), rng.integers(0, 1 << 62, 3000, np.uint64)]))
    keys = np.zeros(len(values), np.int64)
    a, b = simhash._linked(keys, values)
    old, simhash.LONG = simhash.LONG, 100
    c, d = simhash._linked(keys, values)
    simhash.LONG = old
    assert sorted(zip(a, b)) == sorted(zip(c, d)) and len(a) >= 60


def test_bpe():
    import tiktoken

    data, pattern = bpe.vocabulary()
    codec = bpe.Codec(data, pattern)
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(5)
    letters = ["a", "b", "ab", "é", "ü", "th", "中", "\U0001f600", "́", "1", "!", "=", " ", "\n", "'s", "<|endoftext|>"]
    texts = ["".join(rng.choice(letters[: rng.randint(2, 16)]) for _ in range(rng.randint(0, 300))) for _ in range(800)]
    texts += ["a" * 5001, "=" * 9999, "ab" * 3000, "lichkeit" * 900, " " * 3000, "中文" * 2000]
    for text in texts:
        ids = codec.encode(text)
        assert ids == theirs.encode_ordinary(text) and codec.decode(ids) == text.encode()
        assert codec.digest(text) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    for piece in (t.encode()[:200] for t in texts):
        assert codec.tree(piece) == codec.merge_long(piece) == codec.merge(piece)
    old, bpe.SLICE = bpe.SLICE, 7
    assert codec.digest(texts[3] * 9)[0] == len(codec.encode(texts[3] * 9))
    bpe.SLICE = old


def test_bpe_frames(spark):
    docs = read(spark, SF, "documents").limit(20)
    both = bpe.decode(bpe.encode(docs)).select("text", "decoded").collect()
    assert all(bytes(r.decoded) == r.text.encode() for r in both)


def test_chat_events(spark):
    log = [
        (1, 0, 1, "message", "user", "hi"), (1, 1, 2, "message", "assistant", None), (1, 1, 3, "delta", "assistant", "wro"), (1, 1, 4, "delta", None, "ng"),
        (1, 1, 5, "regenerate", None, None), (1, 1, 6, "delta", None, "ri"), (1, 1, 7, "delta", None, "ght"), (1, 0, 8, "edit", None, "hello"),
        (2, 0, 1, "message", None, None), (None, 0, 1, "message", "assistant", "</s>[INST]<\\s>[\\\\INST]"), (None, 0, 1, "message", "assistant", "</s>[INST]<\\s>[\\\\INST]"),
    ]
    events = spark.createDataFrame(log, "conv_id long, message_id long, seq long, kind string, role string, text string").repartition(3)
    found = {r.conv_id: r for r in chat.parse(chat.render(chat.fold(events))).collect()}
    assert [(t.role, t.text) for t in found[1].turns] == [("user", "hello"), ("assistant", "right")] and found[1].loss == "right"
    assert [(t.role, t.text) for t in found[2].turns] == [("", "")] and found[2].loss == ""
    assert [t.text for t in found[None].turns] == ["</s>[INST]<\\s>[\\\\INST]"] * 2 and found[None].loss == "</s>[INST]<\\s>[\\\\INST]" * 2
    span = found[1].loss_spans[0]
    assert found[1].formatted[span.start : span.start + span.length] == "right"
    assert chat.render(chat.fold(events.limit(0))).collect() == []


def test_chat_query(spark):
    table = read(spark, SF, "conversations")
    by = {}
    for r in table.orderBy("conv_id", "turn").collect():
        by.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    by[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    for r in chat.op4(table).collect():
        turns = by.pop(r.conv_id)
        spoken = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(spoken))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(spoken.encode()).hexdigest()
    assert not by


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), [float(x) for x in v]) for k, v in enumerate(rng.normal(size=(400, 24)))]
    rows += [(1000 + k, rows[0][1]) for k in range(30)]
    rows += [(2000, None), (2100, []), (2200, [0.0] * 24), (2300, [math.nan] * 24), (2400, [math.inf] * 24), (2500, [None] * 24), (None, rows[3][1]), (2600, [1.0, 2.0]), (2700, [1.0, 2.5])]
    return rows


def spread(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("key", "bucket", "asks", "vector", "parts")}).repartition(3)


def test_nearest(spark, vectors):
    found = {}
    for r in ann.op5(spread(spark, vectors)).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = [(k, np.array(v)) for k, v in vectors if k is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    hit = total = 0
    for k, q in good:
        if k % 100:
            assert k not in found
            continue
        exact = sorted((math.sqrt(((v - q) ** 2).sum()), i) for i, v in good if i != k and len(v) == len(q))[:10]
        mine = sorted(found[k])
        assert len(mine) == len(exact) and [m[0] for m in mine] == list(range(1, len(exact) + 1))
        dist = dict((i, d) for d, i in ((math.sqrt(((v - q) ** 2).sum()), i) for i, v in good if len(v) == len(q)))
        assert all(abs(s - dist[i]) < 1e-12 for _, i, s in mine)
        hit += len({i for _, i in exact} & {m[1] for m in mine})
        total += len(exact)
    assert hit / total >= 0.9
    assert ann.op5(spread(spark, vectors[:0])).collect() == []


@pytest.mark.parametrize("block", [512, 16384])
def test_a_query_far_from_all_rows_gets_a_whole_answer(spark, block, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", block)
    rng = np.random.default_rng(7)
    axis = np.eye(16)[0]
    x = rng.normal(size=(2500, 16)) * 0.02 + axis
    x[100] = -axis
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)] + [(1, [float(c) for c in x[1]])] * 20
    rows += [(5000 + k, [1.0, float(k)]) for k in range(4)] + [(5000, [1.0, 0.0])]
    found = {}
    for r in ann.op5(spread(spark, rows)).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    exact = sorted((float(np.sqrt(((x[k] - x[100]) ** 2).sum())), k) for k in range(2500) if k != 100)[:10]
    assert sorted(found[100]) == [(n, k) for n, (_, k) in enumerate(exact, 1)]
    assert all(len(found[k]) == 10 for k in range(0, 2500, 100)) and sorted(found[5000]) == [(1, 5001), (2, 5002), (3, 5003)]


def test_recall_on_the_table(spark):
    table = read(spark, "/root/testdata/sf0.1", "embeddings")
    rows = table.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = ann.op5(table).collect()
    hit = 0
    for q in np.unique([r.query_id for r in found]):
        d = ((x - x[ids == q]) ** 2).sum(1)
        d[ids == q] = np.inf
        hit += len({*ids[np.lexsort((ids, d))[:10]]} & {r.vec_id for r in found if r.query_id == q})
    assert hit / len(found) >= 0.9


@pytest.mark.parametrize("block", [64, 16384])
def test_hot_buckets_and_blocks(spark, vectors, block, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(ann, "BLOCK", max(8, block // 8))
    found = {}
    for r in topk.op7(spread(spark, vectors)).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = [(k, np.floor(64 * np.array(v)).astype(int)) for k, v in vectors if k is not None and v and None not in v and np.isfinite(v).all()]
    for k, q in good:
        if k % 20 == 0:
            exact = sorted((-int(v @ q), i) for i, v in good if i != k and len(v) == len(q))[:20]
            assert sorted(found[k]) == [(n + 1, i, -s) for n, (s, i) in enumerate(exact)]


def test_licenses(spark):
    texts = [
        "Under the MIT License", "cc-by-nc cc by nc CC BY NC", "apache license, version 2.0", "apache license version", None, "", "é cc by\nnc",
        "This work is licensed under the GNU very General Public License, version 3.", "under the mit the mit license " * 3,
    ]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        places = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in places]
        r = found[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
    assert found[7].labels == "gpl-3" and found[1].n_base == 3


FSF = "it under the terms of the GNU {} as published by the Free Software Foundation, {} (at your option) any later version."
WORDINGS = [
    ("Licensed under the GNU General Public License version 3", "gpl-3"), ("GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007", "gpl-3"), ("GNU General Public License, Version 2", "gpl-2"),
    (FSF.format("General Public License", "either version 3 of the License, or"), "gpl-3"), (FSF.format("General Public License", "either version 2 of the License, or"), "gpl-2"),
    (FSF.format("General Public License", "version 3 of the License, or"), "gpl-3"), ("under version 3 of the GNU General Public License.", "gpl-3"), ("under version 2 of the GNU General Public License.", "gpl-2"),
    (FSF.format("Affero General Public License", "either version 3 of the License, or"), "agpl"), (FSF.format("Lesser General Public License", "either version 3 of the License, or"), "lgpl"),
    ("to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished", ""),
    ("The above copyright notice and this permission notice shall be included in\nall copies or substantial portions of the Software.", "mit"),
    ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "bsd"),
    ("We, the Free Software Foundation, use the GNU General Public License for most of our software; it applies also to any other work released this way by its authors.", "gpl-3"),
    ("We published the general version 3 of a license for public software.", ""),
]


def test_license_wordings(spark):
    found = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(WORDINGS)], "doc_id long, text string")).collect()}
    assert {t: found[k] for k, (t, _) in enumerate(WORDINGS)} == dict(WORDINGS)


def test_language_models():
    counts = {"aa": (["ab", "aab", "b"], np.array([5, 3, 1])), "zz": (["zy", "zzy"], np.array([4, 2]))}
    model = langid.train(counts)
    symbols = [chr(c) for c in range(32, 128)] + [chr(langid.END)]
    # Probabilities of a context's continuations sum to at most one, and to one over known symbols and the rest.
    scores, lengths = model.score(["ab", "zy", "qq"])
    assert (lengths == [3, 3, 3]).all() and scores[0, 0] > scores[0, 1] and scores[1, 1] > scores[1, 0]
    codes, at = langid._symbols(["a"])
    total = 0.0
    for s in symbols:
        line = codes.copy()
        line[at[1]] = ord(s)
        place, value = at[1], 0.0
        for order in range(langid.ORDER, 0, -1):
            keys, values = model.grams[order - 1]
            where, there = langid._find(keys, langid._grams(line, np.array([place]), order))
            if there[0]:
                value += values[where[0], 0]
                break
            if order > 1:
                keys, weights = model.contexts[order - 1]
                where, there = langid._find(keys, langid._grams(line, np.array([place]) - 1, order - 1))
                value += weights[where[0], 0] if there[0] else 0
            else:
                value += model.floor
        total += math.exp(value) if there[0] or order > 1 else 0
    assert 0.8 < total <= 1.0 + 1e-6


def test_language_accuracy(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    found = langid.op1(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_quality_accuracy(spark):
    docs, labels = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels")
    found = quality.op8(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.quality == r.predicted for r in found]) > 0.95
    held = quality.op8(docs, labels).where("held_out").select("doc_id").collect()
    import zlib

    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)


def test_repeated_keys_count_once_in_the_labelled_sample(spark):
    rows = [(1, "0x1F;; 77 !!" + (" 9" if k % 2 else "")) for k in range(60)] + [(k, "Plain words in a row, well put.") for k in range(2, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(k > 1), 0) for k in range(1, 8)], LABELS)
    voters = quality.fit(docs, labels, 20)
    assert sorted(voters.labels) == [0, 1, 1, 1, 1, 1, 1]
    good = {r.doc_id for r in quality.score(docs, voters).where("score >= 0.3").collect()}
    assert good == set(range(2, 8))


def test_every_character_of_a_long_word_counts():
    def of(*texts):
        return [quality.terms(t, quality.Shapes()).tolist() for t in texts]

    rng = random.Random(12)
    head = "".join(rng.choice("天地玄黃宇宙") for _ in range(64))
    assert len(set(map(tuple, of(head, head + "日月", head + "「日」,月;1", head * 2, head * 40 + "日月!", head * 40 + "日月?")))) == 6
    short = [("ab" * 32)[:k] for k in range(1, 65)]
    shapes = quality.Shapes()
    assert all(terms.sum() == 1 for terms in (quality.terms(t, shapes)[: quality.SHAPES] for t in short))


def brute_repeats(texts, length=400):
    starts = Counter(b[i : i + length] for t in texts for b in [(t or "").encode()] for i in range(len(b) - length + 1))
    for text in texts:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if starts[b[i : i + length]] > 1:
                gone[i : i + length] = True
        yield len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()


@pytest.mark.parametrize(("pairs", "hot"), [(0, 1 << 15), (16, 1 << 15), (16, 3), (0, 1)])
def test_suffix_dedup(spark, pairs, hot, monkeypatch):
    monkeypatch.setattr(suffixdedup, "PAIRS", pairs)
    monkeypatch.setattr(suffixdedup, "HOT", hot)
    monkeypatch.setattr(suffixdedup, "PASSED", 2)
    monkeypatch.setattr(suffixdedup, "RUN", 40)
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefgh \n") for _ in range(2500)) for _ in range(4)]
    noise = lambda n: "".join(rng.choice("klmnü") for _ in range(rng.randint(0, n)))
    texts = [None, "", base[0][:399], base[0][:400], base[0][1:401]]
    for _ in range(60):
        b, a = rng.choice(base), rng.randint(0, 1500)
        texts.append(noise(300) + b[a : a + rng.randint(380, 900)] + noise(300))
        texts.append(rng.choice(["A ", "the ", "Reanwh ", "é"]) * rng.randint(90, 700))
        x = rng.choice(base)[100 : 100 + rng.randint(300, 500)]
        texts.append(x + "|" + x)
    rows = [*enumerate(texts), (10_000, texts[7])]
    found = {r.doc_id: tuple(r)[1:] for r in suffixdedup.op9(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert [found[k][:4] for k, _ in rows] == [*brute_repeats([t for _, t in rows])]
    assert [found[k][4:] for k, _ in rows] == [(len(x), sum(b - a for a, b in x)) for x in brute_passages([t for _, t in rows])]


#: Ideographs and kana are words by themselves.
WORD = r"[\u3000-\u9fff]|[^\x20\x09-\x0D\u3000-\u9fff]+"


def brute_passages(texts, length=51):
    """Runs of words that repeated passages cover, as (first word, word behind the last)."""
    words = [re.findall(WORD, t or "") for t in texts]
    starts = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    for w in words:
        gone = np.zeros(len(w) + 2, int)
        for i in range(len(w) - length + 1):
            if starts[tuple(w[i : i + length])] > 1:
                gone[i + 1 : i + 1 + length] = 1
        edge = np.diff(gone)
        yield [*zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]


@pytest.mark.parametrize(("pairs", "hot"), [(0, 1 << 15), (16, 1 << 15), (16, 3), (0, 1)])
def test_passages(spark, pairs, hot, monkeypatch):
    """Passages of 51 words, some under 400 bytes, go by words, whatever stands between them; what is shorter stays."""
    monkeypatch.setattr(suffixdedup, "PAIRS", pairs)
    monkeypatch.setattr(suffixdedup, "HOT", hot)
    monkeypatch.setattr(suffixdedup, "RUN", 40)
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcdeé中") for _ in range(rng.randint(1, 6)))
    passage = [[word() for _ in range(n)] for n in (50, 51, 51, 60, 140)]
    texts = [None, "", " \t", " ".join(passage[1]), "x" * 70_000 + " " + " ".join(passage[1]), "x" * 70_000 + " b"]
    for _ in range(60):
        own = lambda: [word() + "z" for _ in range(rng.randint(0, 80))]
        of = rng.choice(passage)
        cut = rng.choice([of, of, of[: rng.randint(1, len(of))], of[rng.randint(0, len(of) - 1) :]])
        texts.append("".join(w + rng.choice([" ", " ", "\n", "  "]) for w in own() + cut + own()))
    rows = [*enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spans = [*brute_passages(texts)]
    found = {r.doc_id: (r.n_passages, r.n_passage_words) for r in suffixdedup.op9(frame).collect()}
    assert [found[k] for k, _ in rows] == [(len(x), sum(b - a for a, b in x)) for x in spans]
    assert any(spans) and not all(spans[6:])
    kept = {r.doc_id: r.text for r in suffixdedup.remove_repeats(frame, measures=(suffixdedup.WORDS,)).collect()}
    for (k, text), gone in zip(rows, spans):
        words = re.findall(WORD, text or "")
        left = [w for i, w in enumerate(words) if not any(a <= i < b for a, b in gone)]
        assert kept[k] is None if text is None else "".join(kept[k].split()) == "".join(left)


def test_word_codes_do_not_hang_on_chunks(monkeypatch):
    rng = random.Random(17)
    texts = ["".join(rng.choice(["ab", "ab", "c", "é", " ", "\n", "x" * 40, "中", "の国"]) for _ in range(rng.randint(0, 90))).encode() for _ in range(50)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = np.r_[0, ends[:-1]]
    bounds = suffixdedup.word_bounds(data, starts, ends)
    assert [bytes(data[a:b]) for a, b in zip(*bounds)] == [w.encode() for t in texts for w in re.findall(WORD, t.decode())]
    codes = suffixdedup.word_codes(data, *bounds)
    of = {}
    assert all(of.setdefault(bytes(data[a:b]), c) == c for a, b, c in zip(*bounds, codes)) and len(set(of.values())) == len(of)
    for chunk in (1, 7, 64):
        monkeypatch.setattr(suffixdedup, "CHUNK", chunk)
        assert all((x == y).all() for x, y in zip(suffixdedup.word_bounds(data, starts, ends), bounds))
        assert (suffixdedup.word_codes(data, *bounds) == codes).all()


def test_loser_tree():
    rng = random.Random(8)
    runs = [sorted(("".join(rng.choice("ab") for _ in range(rng.randint(0, 30))).encode(), b"", 0, 0, False) for _ in range(rng.randint(0, 40))) for _ in range(7)]
    out = [*suffixdedup.merged([suffixdedup.unpack(suffixdedup.pack(r)) for r in runs if r])]
    assert [x[0] for _, x in out] == sorted(x[0] for r in runs for x in r)
    for (_, a), (n, b) in zip(out, out[1:]):
        assert n == suffixdedup.common(a[0], b[0])


def test_chunks_change_nothing(monkeypatch):
    data = np.frombuffer(("".join(random.Random(9).choice("abcd") for _ in range(30000))).encode(), np.uint8)
    bounds = np.array([0, 100, 9000, 9100]), np.array([100, 9000, 9100, 30000])
    covers = lambda: {(int(t), int(p), s) for g, *x in suffixdedup.anchors(data, *bounds, suffixdedup.BYTES) for t, p, a, b in zip(*x) for s in range(a, b + 1)}
    one = covers()
    monkeypatch.setattr(suffixdedup, "CHUNK", 1000)
    assert covers() == one and len(one) == sum(max(0, b - a - 399) for a, b in zip(*bounds))


def test_mixing(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    rows = mixing.op10(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    again = mixing.op10(docs.repartition(5)).join(docs.select("doc_id", "source"), "doc_id").collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    total = sum(r["size"] for r in rows)
    goal, taken = {}, Counter()
    for r in rows:
        goal[r.source] = (r.target, r.source_size)
        taken[r.source] += r.taken
        assert r.taken in (0, r["size"], 2 * r["size"])
    assert abs(sum(t for t, _ in goal.values()) - 1.5 * total) < 1e-6 * total
    # Water filling: weights 5, 2, 1 in turn, stopped at twice the size.
    names, weight = sorted(goal), {}
    for k, name in enumerate(names):
        weight[name] = (5, 2, 1)[k % 3]
    level = [goal[x][0] / weight[x] for x in names if goal[x][0] < 2 * goal[x][1] - 1e-6]
    assert max(level) - min(level) < 1e-6
    for x in names:
        assert abs(taken[x] - goal[x][0]) < 0.15 * goal[x][0] + 1
    mixed = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert mixed == Counter({r.doc_id: r.taken // r["size"] for r in rows if r.taken})


def test_registered():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 11))


def test_pieces_change_nothing(monkeypatch):
    from tidemark.llm import util

    rng = random.Random(11)
    texts = ["".join(rng.choice(["a", "Bc", " ", "\n", "\u00a0", "é!", "A "]) for _ in range(rng.randint(0, 400))) for _ in range(60)] + ["x" * 500, " " * 300]
    whole = [(simhash.fingerprint(t), quality.terms(t, quality.Shapes()).tolist()) for t in texts]
    assert [w for w, _ in whole] == [plain_fingerprint(t) for t in texts]
    monkeypatch.setattr(util, "PIECE", 20)
    for text, (one, two) in zip(texts, whole):
        assert simhash.fingerprint(text) == one and np.allclose(quality.terms(text, quality.Shapes()), two)
        assert [w for p in util.word_pieces(text) for w in p] == text.split() and [w for p in util.word_pieces(text.encode()) for w in p] == text.encode().split()
