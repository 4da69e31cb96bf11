"""Operators over whole corpora against brute force: scoring, duplicates, passages, the classifier, the pipeline."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest import SF

from sediment.llm import brown, classifier, common, queries, shingles, simhash, suffix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, word string, y string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "w", "y") for i, t in rows], SCHEMA)


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(t))


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


# Class-based n-grams


def check_base(spark, rows, s):
    out = brown.score_texts(frame(spark, rows), s).collect()
    tokens = [(d, [*words(t), ""]) for d, t in rows]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    c = Counter(w for d, ws in tokens if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((d, held(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6) + 0.0) for d, ws in tokens)
    got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6) + 0.0) for r in out)
    assert got == want
    assert all(math.isfinite(r["score"]) for r in out)
    return out


@pytest.mark.parametrize("s", [brown.Settings(classes=8, words=20, endings=20), brown.Settings(classes=4, words=5, endings=5, frequent=10, kept=20)])
def test_brown_counts_and_base(spark, s):
    rows = [(i, prose(i % 17, 30 + i % 5)) for i in range(60)] + [(100, None), (101, ""), (None, "null id"), (3, "twice here"), (3, "twice here"), (102, "Unseen WORDS " * 3000), (103, "x" * 5000)]
    check_base(spark, rows, s)


def test_brown_without_training(spark):
    check_base(spark, [], brown.Settings())
    check_base(spark, [(i, "a b") for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1], brown.Settings())


def test_exchange_groups_words_of_like_context():
    rng = random.Random(1)
    size = 41
    pairs = np.zeros((size, size))
    for _ in range(40_000):
        a = rng.randint(1, 40)
        b = rng.choice([x for x in range(1, 41) if (x <= 20) != (a <= 20)])
        pairs[a, b] += 1
    at = brown.exchange(pairs, 7, 20)
    assert at[0] == 0 and not set(at[1:21]) & set(at[21:])


def objective(pairs, at, k):
    f = lambda x: float((x * np.log(np.maximum(x, 1e-300))).sum())
    member = np.eye(k)[at]
    joint = member.T @ pairs @ member
    return f(joint) - f(joint.sum(1)) - f(joint.sum(0))


def test_exchange_ends_where_no_move_gains():
    rng = np.random.default_rng(4)
    pairs = rng.poisson(3, (25, 25)).astype(float) * rng.integers(0, 2, (25, 25))
    at = brown.exchange(pairs, 5, 50)
    best = objective(pairs, at, 5)
    for u in range(1, 25):
        for g in range(1, 5):
            moved = at.copy()
            moved[u] = g
            assert objective(pairs, moved, 5) <= best + 1e-6


def brute_contexts(texts, units, at, k, n):
    """Unit -> counts of classes after it, of classes before it, and of itself after it; units 1 to n."""
    out = {}
    for t in texts:
        chain = [0, *units.of([w.encode() for w in words(t)]).tolist(), 0]
        for a, b in zip(chain, chain[1:]):
            out.setdefault(a, Counter())[int(at[b])] += 1
            out.setdefault(b, Counter())[k + int(at[a])] += 1
            if a == b:
                out[a][2 * k] += 1
    return {u: near for u, near in out.items() if 1 <= u <= n}


def test_brown_sweep_moves_each_word_to_its_best_class(spark):
    """Against recounted likelihoods: words that are endings in the core are classed by their own neighbours."""
    rng = random.Random(3)
    sides = [[f"{c}{i}zzzz" for i in range(12)] for c in "ab"]
    texts = [" ".join(rng.choice(sides[(i + s) % 2]) for i in range(40)) for s in range(30)]
    train = frame(spark, [*enumerate(texts), (98, None), (99, "")])
    every = sorted({w for t in texts for w in t.split()})
    units = brown.Units([w.encode() for w in every], [b"zzzz"], 4, 6)
    held = brown.chains(train, units)
    pairs = brown.class_pairs(held, units.coarse, int(units.coarse.max()) + 1)
    core = brown.exchange(pairs, 5, 20)
    k = int(core.max()) + 1
    at, joint = core[units.coarse], np.eye(k)[core].T @ pairs @ np.eye(k)[core]
    n = len(every) - 3
    contexts = brown.word_contexts(held, at, k, n)
    got = {r["unit"]: Counter({x["code"]: x["c"] for x in r["near"]}) for r in contexts.collect()}
    assert got == brute_contexts([*texts, "", ""], units, at, k, n)
    moved = brown.sweep(contexts, at, joint)
    fine = brown.class_pairs(held, np.arange(units.size), units.size)
    assert abs(brown.likelihood(joint) - objective(fine, at, k)) < 1e-6
    for u in range(1, n + 1):
        tried = []
        for g in range(1, k):
            other = at.copy()
            other[u] = g
            tried.append(objective(fine, other, k))
        assert max(tried) - tried[moved[u] - 1] < 1e-6
    assert moved[0] == 0 and (moved[n + 1 :] == at[n + 1 :]).all() and brown.likelihood(brown.class_pairs(held, moved, k)) > brown.likelihood(joint)


def test_brown_probabilities_add_up(spark):
    """Over all words and one unseen outcome a class, each history's probabilities sum to one."""
    rows = [(i, prose(i % 5, 40)) for i in range(30)]
    s = brown.Settings(classes=5, words=30, endings=10, sweeps=2, least=2)
    model, _ = brown.train_model(frame(spark, rows), s)
    c = Counter(w for _, t in rows for w in [*words(t), ""])
    z = model.total + 0.5 * (model.types + 1)
    for h in range(model.seen.shape[0]):
        total = sum((n + 0.5) * 10 ** model.seen[h, model.at[model.units.of([w.encode()])[0]] if w else 0] for w, n in c.items())
        unseen = sum(10 ** model.unseen[h, g] - (1 - s.mix) * 0.5 / z for g in range(model.seen.shape[1])) + (1 - s.mix) * 0.5 / z
        assert abs(total + unseen - 1) < 1e-6


def test_brown_beats_the_base_on_held_out_texts(spark):
    out = queries.op2_brown(spark, SF).where("held_out").toPandas()
    assert out["score"].sum() > out["base_score"].sum()


# SimHash


def brute_fp(t, k):
    w = words(t)
    if not w:
        return 0
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)]
    bits = [0] * 64
    for x in s:
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(s))


def closure(nodes, links):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        if x != y:
            top[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash_rows(spark):
    rows = [(i, prose(i, 60)) for i in range(40)] + [(50 + i, prose(i, 60).upper()) for i in range(10)] + [(70, None), (71, ""), (72, "one"), (73, "one two"), (74, "One  two"), (75, "w " * 50_000)]
    out = simhash.near_duplicates(frame(spark, rows)).collect()
    fps = {d: brute_fp(t, 3) for d, t in rows}
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    top = closure(fps, links)
    assert {(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in out} == {(d, fps[d], top[d]) for d in fps} and len(out) == len(rows)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("crowd", [64, 8, 1])
def test_links_have_the_components_of_all_pairs(spark, crowd):
    rng = random.Random(3)
    points = set()
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(30):
            y = x
            for b in rng.sample(range(64), rng.randint(0, 3)):
                y ^= 1 << b
            points.add(y - 2**64 if y >> 63 else y)
    points = sorted(points)
    got = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(p,) for p in points], "fp long"), crowd=crowd).collect()]
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2
    assert all(near(a, b) for a, b in got)
    assert closure(points, got) == closure(points, [(a, b) for i, a in enumerate(points) for b in points[:i] if near(a, b)])


def test_manhattan_distance_is_a_lower_bound(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows = [tuple(x - 2**64 if x >> 63 else x for x in (rng.getrandbits(64), rng.getrandbits(64))) for _ in range(200)]
    df = spark.createDataFrame(rows, "a long, b long").select("a", "b", simhash._counts(F.col("a")).alias("x"), simhash._counts(F.col("b")).alias("y"))
    for r in df.select("a", "b", simhash._distance("x", "y").alias("d")).collect():
        a, b = r["a"] % 2**64, r["b"] % 2**64
        want = sum(abs((a >> i & 3).bit_count() - (b >> i & 3).bit_count()) for i in range(0, 64, 2))
        assert r["d"] == want <= (a ^ b).bit_count()


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(150)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5000, 5000), (6001, 6000), (6000, 6001)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = closure({x for e in edges for x in e} - {5000}, [e for e in edges if e[0] != e[1]])
    assert got == want


def test_distinct_documents(spark):
    rows = [(5, "same text here"), (2, "SAME text  here"), (2, "SAME text  here"), (9, prose(1, 50)), (None, "same text here"), (10, None), (11, "")]
    docs = frame(spark, rows)
    out = simhash.distinct_documents(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [2, 9, 10]
    assert simhash.distinct_documents(frame(spark, [])).count() == 0


# Repeated passages


def brute_passages(rows, length):
    own = defaultdict(set)
    split = {(d, t): words(t) for d, t in rows}
    for key, w in split.items():
        for i in range(len(w) - length + 1):
            own[tuple(w[i : i + length])].add(key)
    out = defaultdict(set)
    for key, w in split.items():
        for i in range(len(w) - length + 1):
            if len(own[tuple(w[i : i + length])]) > 1:
                out[key[0]].update(range(i, i + length))
    return out


def test_passages(spark):
    common_part = prose(99, 60)
    rows = [(i, f"{prose(i, 40)} {common_part} {prose(1000 + i, 30)}") for i in range(8)] + [(20, prose(5, 300)), (21, prose(5, 300)), (22, prose(5, 300).upper()), (23, prose(7, 49)), (24, prose(7, 49)), (25, None), (26, ""), (27, "same " * 3000), (28, "z " * 200), (20, prose(5, 300)), (29, prose(8, 50)), (30, prose(8, 50))]
    out = suffix.repeated_passages(frame(spark, rows)).collect()
    got = defaultdict(set)
    split = {d: words(t) for d, t in rows}
    for r in out:
        got[r["doc_id"]].update(range(r["start"], r["end"]))
        a, b = split[r["doc_id"]], split[r["other_id"]]
        assert r["n_words"] == r["end"] - r["start"] >= 50 and r["other_id"] != r["doc_id"]
        assert any(a[r["start"] + i : r["start"] + i + 50] == b[r["other_start"] : r["other_start"] + 50] for i in range(r["n_words"]))
    assert got == brute_passages(rows, 50)
    assert suffix.repeated_passages(frame(spark, [])).count() == 0


def covered(df):
    got = defaultdict(set)
    for r in df.collect():
        got[r["doc_id"]].update(range(r["start"], r["end"]))
    return got


def forms(n, values):
    """Texts that share long parts and differ in two fields: only equal pairs of fields make 50 words."""
    rng = random.Random(n)
    a, b, c = prose(501, 20), prose(502, 22), prose(503, 20)
    return [(i, f"{prose(10_000 + i, 5)} {a} f{rng.randrange(values)} {b} g{rng.randrange(values)} {c} {prose(20_000 + i, 5)}") for i in range(n)]


def test_passages_among_texts_that_differ_in_few_words(spark):
    rows = forms(300, 15) + [(1000 + i, f"{prose(504, 45)} {prose(600 + i // 2, 8)} {prose(30_000 + i, 20)}") for i in range(60)]
    want = brute_passages(rows, 50)
    assert len(want) > 150 and covered(suffix.repeated_passages(frame(spark, rows))) == want


@pytest.mark.parametrize("crowd", [1, 7])
def test_passages_of_crowded_keys(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix, "CROWD", crowd)
    header, whole = prose(505, 45), prose(506, 70)
    rows = [(i, f"{prose(40_000 + i, 6)} {header} {prose(700 + i // 2, 8)} {prose(50_000 + i, 6)}") for i in range(60)]
    rows += [(2000 + i, f"{prose(60_000 + i, 9)} {whole} {prose(70_000 + i, 9)}") for i in range(20)] + [(3000, "same " * 300), (3001, "same " * 120 + "end " * 60)]
    want = brute_passages(rows, 50)
    assert len(want) == 82 and covered(suffix.repeated_passages(frame(spark, rows))) == want


# Classifier


def test_classifier_learns_and_holds_out(spark):
    rng = random.Random(2)
    good, bad = "the of and to in is it".split(), "!! ## BUY CLICK $$ win".split()
    rows = [(i, " ".join(rng.choices(good if i % 4 else bad, k=30)) + " " + prose(i, 5)) for i in range(300)] + [(900, None), (901, ""), (902, "the " * 50_000)]
    labels = spark.createDataFrame([(i, 1 if i % 4 else 0, 0) for i in range(300)] + [(1, None, 0), (None, 1, 0), (5, 1, 1), (5555, 1, 1)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    fitted = classifier.fit(docs, labels)
    out = {r["doc_id"]: r for r in classifier.score(docs, *fitted).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for d, r in out.items())
    held = [d for d in range(300) if out[d]["held_out"]]
    assert np.mean([out[d]["predicted"] == (1 if d % 4 else 0) for d in held]) > 0.95
    assert out[900]["score"] == out[901]["score"]
    kept = {r["doc_id"] for r in classifier.accepted(docs, *fitted).collect()}
    assert kept == {d for d, r in out.items() if r["predicted"]}
    none = classifier.fit(docs, labels.limit(0))
    assert {r["score"] for r in classifier.score(docs, *none).collect()} == {0.5}
    assert classifier.score(frame(spark, []), *fitted).count() == 0


def test_classifier_never_sees_held_out_labels(spark):
    docs = frame(spark, [(i, prose(i, 20)) for i in range(60)])
    labels = [(i, i % 2) for i in range(60)]
    other = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    a, b = (classifier.fit(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, other))
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]


def plain_features(text, bits):
    """Feature numbers of a text by the definition, word by word."""
    tokens = [zlib.crc32(t) for t in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+", text)]
    tokens = [classifier.REPEATED if i and t == tokens[i - 1] else t for i, t in enumerate(tokens)]
    out = set()
    for n in (1, 2):
        for i in range(len(tokens) - n + 1):
            mix = n
            for t in tokens[i : i + n]:
                mix = (mix ^ t) * 0x9E3779B97F4A7C15 % 2**64
                mix ^= mix >> 29
            out.add(mix >> (64 - bits))
    return sorted(out)


def test_classifier_equals_plain_ftrl(spark):
    """Weights and scores against FTRL-proximal written out for one weight at a time."""
    s = classifier.Settings(bits=12, epochs=2)
    rng = random.Random(6)
    rows = [(i, f"{prose(i, 8)} {'!! buy' if i % 3 else 'the of'} {rng.randrange(5)}") for i in range(40)] + [(50, ""), (51, None), (7, "another text of seven")]
    labels = [(i, int(i % 3 == 0)) for i in range(40)] + [(50, 1), (51, 0)]
    fitted = classifier.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int"), s=s)
    swapped = classifier.fit(frame(spark, rows[::-1]), spark.createDataFrame(labels, "doc_id long, quality int"), s=s)
    assert np.array_equal(fitted[0], swapped[0]) and fitted[1] == swapped[1]
    sevens = [t for d, t in rows if d == 7]
    first = spark.createDataFrame([(t,) for t in sevens], "t string").selectExpr("t").orderBy(common.F.xxhash64("t")).first()["t"]
    text = {d: (t or "").encode() for d, t in rows if d != 7} | {7: first.encode()}
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= s.l1 else -(z[i] - math.copysign(s.l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    train = [(d, y) for d, y in labels if zlib.crc32(str(d).encode()) % 3 != 1]
    for _ in range(s.epochs):
        for d, y in sorted(train, key=lambda x: (zlib.crc32(str(x[0]).encode()), x[0])):
            at = plain_features(text[d], s.bits)
            x = {i: 1 / math.sqrt(max(1, len(at))) for i in at} | {-1: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha * w[i]
                n[i] += g * g
    assert abs(fitted[1] - weight(-1)) < 1e-6 and all(abs(fitted[0][i] - weight(i)) < 1e-5 for i in range(1 << s.bits))
    for r in classifier.score(frame(spark, rows), *fitted, s=s).where("doc_id <> 7").collect():
        at = plain_features(text[r["doc_id"]], s.bits)
        assert abs(r["score"] - 1 / (1 + math.exp(-weight(-1) - sum(weight(i) for i in at) / math.sqrt(max(1, len(at)))))) < 1e-4


# Pipeline


def similar(texts):
    """The least id that each text is linked with: five-word shingle sets of similarity 0.8 or more, by all pairs."""
    split = {d: words(t) for d, t in texts.items()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for d, w in split.items()}
    return closure(sets, [(a, b) for a in sets for b in sets if a < b and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))])


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from sediment.llm import decontam, secrets

    docs = common.table(spark, SF, "documents")
    bench = [(str(r["item_id"]), r["text"]) for r in common.table(spark, SF, "benchmark").collect()]
    texts = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = {r["doc_id"]: r.asDict() for r in docs.collect()} if k else {r["doc_id"]: r.asDict() for r in docs.collect()}
        out = common.stored(stage(spark, docs, SF), f"t{k}")
        if k < 4:
            assert out.columns == docs.columns
            texts = {r["doc_id"]: r["text"] for r in out.collect()}
            assert set(texts) <= set(before)
        if k == 0:
            fitted = classifier.fit(docs, common.table(spark, SF, "labels"))
            assert set(texts) == {r["doc_id"] for r in classifier.score(docs, *fitted).where("predicted = 1").collect()}
        if k == 1:
            top = similar({d: r["text"] for d, r in before.items()})
            assert set(texts) == {d for d in top if top[d] == d}
        if k == 2:
            block = [decontam.Automaton([(n, decontam.words_of((t or "").encode())) for n, t in bench], 10)]
            for d, r in before.items():
                _, spans, _ = decontam.scan((r["text"] or "").encode(), block)
                if not spans:
                    assert texts[d] == r["text"]
                elif d in texts:
                    assert not decontam.scan(texts[d].encode(), block)[1]
        if k == 3:
            assert set(texts) == set(before)
            for d, r in before.items():
                assert (texts[d] == r["text"]) == (not secrets.find((r["text"] or "").encode(), 0.7, secrets.Novelty())[2])
                assert not [s for s in secrets.base_spans(texts[d] or "") if "REDACTED" not in texts[d][s[0] : s[2]]]
        if k == 4:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(queries.tokenizer_path())
            for r in out.collect():
                ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
                assert bytes(r["ids"]) == b"".join(i.to_bytes(4, "little") for i in ids)
            assert out.count() == len(texts)
        docs = out


@pytest.mark.parametrize("frequent", [262_144, 0])
def test_near_dedup_finds_all_pairs_of_similarity(spark, monkeypatch, frequent):
    pipeline = pytest.importorskip("corpus_pipeline")
    monkeypatch.setattr(shingles, "FREQUENT", frequent)
    rng, rows, line = random.Random(9), [], prose(800, 12)
    for i in range(40):
        base = f"{prose(801 + i, rng.choice([9, 30, 120]))} {line}".split()
        for _ in range(4):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice("pqrs")
            rows.append((len(rows), " ".join(w[: len(w) - rng.randint(0, 3)])))
    sets = {d: {tuple(w[i : i + 5]) for w in [words(t)] for i in range(len(w) - 4)} for d, t in rows}
    near = [(a, b) for a in sets for b in sets if a < b and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    top = closure(sets, near)
    assert sum(sets[a] != sets[b] for a, b in near) > 30
    assert {r["doc_id"] for r in pipeline.simhash_dedup(spark, frame(spark, rows), SF).collect()} == {d for d in sets if top[d] == d}


def test_stretches_keep_neighbours(spark, monkeypatch):
    """A crowd cut into overlapping stretches has the pairs of the whole order, and no stretch holds the crowd."""
    zero = [0] * shingles.LONGS
    rows = [(7, s, 10, 0, s, zero, 1000) for s in range(1000)] + [(8, s, 10, 0, s, zero, 3) for s in range(2000, 2003)]
    rows = spark.createDataFrame(rows, "h long, s long, n long, i long, component long, counts array<long>, many long")
    pairs = {}
    for width in (64, 1000):
        monkeypatch.setattr(shingles, "STRETCH", width)
        pairs[width] = {(r["a"], r["b"]) for r in shingles._beside(rows).collect()}
    assert pairs[64] == pairs[1000]
    assert len(pairs[1000]) == 4 * 1000 - 10 + 3


def test_pipeline_edges(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, None), (2, ""), (2, ""), (None, "x y"), (3, "w " * 30_000), (4, f"password={'Ab9' * 6}")]
    for case in (rows, []):
        docs = frame(spark, case)
        for k, (_, stage) in enumerate(pipeline.STAGES):
            docs = common.stored(stage(spark, docs, str(tmp_path)), f"e{k}")
        assert docs.count() == (4 if case else 0)


def test_near_dedup_starts_from_fingerprints(spark, monkeypatch):
    """The pipeline's stage searches the fingerprints of all its texts, and proposes what all pairs within two bits connect."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from pyspark.sql import functions as F

    seen, real = [], shingles.links
    monkeypatch.setattr(shingles, "links", lambda fps: seen.append(sorted(r["fp"] for r in fps.collect())) or real(fps))
    base = prose(77, 400).split()
    rows = [(0, None), (1, ""), (2, "a b"), (3, " ".join(base)), (4, " ".join([*base, "z"])), (5, " ".join([*base, "y"])), (6, " ".join(base * 2)), (7, prose(78, 60))]
    docs = frame(spark, rows)
    assert {r["doc_id"] for r in pipeline.simhash_dedup(spark, docs, SF).collect()} == {0, 2, 3, 7}
    prints = {d: simhash.fingerprint((t or "").encode(), 5) for d, t in rows}
    assert seen == [sorted(set(prints.values()))]
    made = shingles._sets(docs.withColumns({"__id": F.col("doc_id"), "__row": F.col("doc_id")}), 5)
    name = {r["__id"]: r["s"] for r in made.collect()}
    near = [(name[a], name[b]) for a in prints for b in prints if bin((prints[a] ^ prints[b]) & (2**64 - 1)).count("1") <= 2]
    assert any(a != b for a, b in near)
    found = [(r["a"], r["b"]) for r in shingles._by_fingerprint(made).collect()]
    assert closure(name.values(), found) == closure(name.values(), near)
