"""Operators that SQL can't state, against brute force, exact round trips and held-out labels."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from meridio.llm import bpe, exactdup, licences, mixing, neardup, quality, secretscan, topk, toxicity
from meridio.llm._shared import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").cache()


def pairs_of(text):
    w = re.findall(r"\w+", text.lower())
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(w)


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def linked(sets, threshold):
    """Components of all pairs whose similarity reaches the threshold, by comparing every pair."""
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if sets[i] and sets[j] and similarity(sets[i], sets[j]) >= threshold:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return Counter(top(i) for i in ids)


def against_all_pairs(rows, got, threshold=0.6):
    """How many documents differ from what comparing all pairs gives; no link may be found that isn't there."""
    sets, words = {i: pairs_of(t) for i, t in rows}, {i: tuple(re.findall(r"\w+", t.lower())) for i, t in rows}
    root, links = {i: i for i in sets}, {i: set() for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if sets[i] and sets[j] and similarity(sets[i], sets[j]) >= threshold:
                a, b = sorted((top(i), top(j)))
                root[b] = a
                if words[i] != words[j]:
                    links[i].add(words[j])
                    links[j].add(words[i])
    size = Counter(top(i) for i in ids if sets[i])
    want = {i: (top(i), len(links[i])) for i in ids if sets[i] and size[top(i)] > 1}
    have = {r.doc_id: (r.class_id, r.n_links) for r in got}
    assert len(have) == len(got)
    for i, (c, n) in have.items():
        assert top(i) == top(c) and n <= len(links[i])
    return sum(want.get(i) != have.get(i) for i in ids), len(want)


def test_near_duplicates_against_all_pairs(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    wrong, all_ = against_all_pairs(rows, neardup.near_duplicate_classes(docs).collect())
    assert all_ and wrong <= 0.01 * len(rows)


def test_near_duplicates_in_chains_and_blocks(spark, monkeypatch):
    """Classes whose members aren't all alike, buckets and hubs split into blocks of a few, and a group of equal texts."""
    import random

    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "SPOKES", 2)
    r = random.Random(11)
    texts = []
    for _ in range(30):
        own = [f"w{r.randrange(500)}" for _ in range(60)]
        for _ in range(8):
            texts.append(" ".join(own))
            for k in r.sample(range(60), 5):
                own[k] = f"w{r.randrange(500)}"
    texts += [texts[0]] * 20
    rows = list(enumerate(texts))
    got = neardup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    wrong, all_ = against_all_pairs(rows, got)
    assert all_ > 200 and wrong <= 0.02 * all_
    kept = neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).count()
    assert kept == len(rows) - len(got) + len({r.class_id for r in got})


def test_sequential_verification_keeps_pairs_at_the_threshold():
    least, sure = neardup.bounds(0.6, 0.002)
    assert list(least) == sorted(least) and least[-1] < sure <= neardup.HASHES
    assert least[-1] < 0.6 * neardup.HASHES  # a pair at the threshold isn't ruled out on average


def test_exact_duplicates_against_a_dictionary(docs):
    want = {}
    for r in docs.select("doc_id", "text").collect():
        key = re.sub(r"[ \t\n\r\f\x0b]+", " ", r.text).strip(" ")
        want.setdefault(key, []).append(r.doc_id)
    got = {r.doc_id: r.n_copies for r in exactdup.exact_duplicate_groups(docs).collect()}
    assert got == {min(v): len(v) for v in want.values()}


def test_mixing_meets_its_targets(docs):
    weights = mixing.tempered_weights(docs)
    w = {r.source: r.weight for r in weights.collect()}
    assert abs(sum(w.values()) - 1) < 1e-9
    rows = mixing.source_copies(docs, weights).collect()
    n, total = Counter(r.source for r in rows), len(rows)
    taken = Counter()
    for r in rows:
        taken[r.source] += r.copies
        due = total * w[r.source] / n[r.source]
        assert int(due) <= r.copies <= int(due) + 1
    for s, share in w.items():
        assert abs(taken[s] - total * share) < 1 + 1e-6
    assert mixing.mix_sources(docs, weights).count() == sum(taken.values())


def test_pivotal_rounding_is_unbiased():
    import numpy as np

    p = np.array([0.1, 0.4, 0.7, 0.3, 0.9, 0.6])
    total = np.zeros(6)
    for seed in range(2000):
        out = mixing.duel(p, np.arange(6, dtype=np.int64), seed)
        assert abs(out.sum() - p.sum()) < 1e-6
        total += out
    assert np.abs(total / 2000 - p).max() < 0.05


def test_bpe_equals_the_sequential_algorithm_and_round_trips(spark, docs):
    import tiktoken

    ranks = bpe.Vocabulary(bpe.VOCAB).ranks
    want = tiktoken.Encoding("x", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.encode(docs, carry=["doc_id", "text"], check_col="ok")
    for r in rows.collect():
        assert r.ok and r.token_ids == want.encode_ordinary(r.text), r.doc_id
    assert bpe.decode(rows).where("decoded <> text").count() == 0


def test_quality_on_held_out_labels(spark, docs):
    labels = table(spark, SF, "labels")
    some = labels.where("quality = 1").select("doc_id")
    scores = quality.quality_scores(docs, some, carry=["doc_id"])
    got = {r.doc_id: r.kept for r in scores.collect()}
    mark = {r.doc_id: r.quality for r in labels.where("quality is not null").collect()}
    good = [got[i] for i, q in mark.items() if q == 1]
    bad = [got[i] for i, q in mark.items() if q == 0]
    assert sum(good) >= 0.95 * len(good)
    assert not bad or sum(bad) < len(bad) / 2


def test_kneser_ney_probabilities_sum_to_one(spark):
    import numpy as np

    text = spark.createDataFrame([("en", "the cat sat on the mat and the dog sat on the log. " * 3)], "lang string, text string")
    path = f"{quality.new_path(spark, 'kn-test')}"
    quality.kneser_ney(quality.ngram_counts(text)).write.parquet(path)
    model = quality.Shards(path, "en")
    code, _ = quality.encode(["the cat sat"])
    history = int(code[-1]) >> quality.BITS
    every = np.array([(history << quality.BITS | s) & ((1 << quality.BITS * quality.ORDER) - 1) for s in range(1 << quality.BITS)])
    assert abs(np.exp(model.logp(every)).sum() - 1) < 1e-4


def test_toxic_clauses():
    judge = toxicity.Matcher(toxicity.LEXICON)
    score = lambda t: judge.score(t)[0]
    assert score("You are an idiot.") > score("An idiot.") > 0
    assert score("You are not an idiot.") == 0
    assert score("He said you are an idiot.") < score("You are an idiot.")
    assert score("I will kill you.") >= 3 and score("We kill time.") == 0
    assert score("What a lovely morning for you.") == 0


def test_the_composed_machine_equals_its_parts_and_their_definitions():
    """Every clause of up to three words, and many longer ones: the cascade run letter by letter, and scopes looked up directly."""
    import itertools
    import random

    t = toxicity
    letters = [t.OTHER, t.INSULT, t.MILD, t.STRONGER, t.TARGET, t.SELF, t.WILL, t.ACT, t.NOT, t.SAY]
    machine, r = t.grammar(), random.Random(4)

    def composed(clause):
        state, total = machine.start, 0.0
        for x in clause:
            _, state, w = machine.step(state, x)
            total += w
        return total

    def one_after_another(clause):
        total, tape = 0.0, list(clause)
        for part in t.cascade():
            state, out = part.start, []
            for x in tape:
                y, state, w = part.step(state, x)
                out.append(y)
                total += w
            tape = out
        return total

    def in_scope(clause, i, trigger, reach, passing=()):
        near = [j for j in range(i) if clause[j] == trigger]
        return bool(near) and sum(x not in passing for x in clause[near[-1] + 1 : i]) < reach

    def insults(clause):
        total = 0.0
        for i, x in enumerate(clause):
            if x in t.WEIGHTS:
                w = t.WEIGHTS[x] * (t.INTENSE if in_scope(clause, i, t.STRONGER, 2) else 1.0) * (t.AIMED if in_scope(clause, i, t.TARGET, 5, (t.STRONGER,)) else 1.0)
                total += w * (t.NEGATED if in_scope(clause, i, t.NOT, 4, (t.STRONGER,)) else 1.0) * (t.REPORTED if in_scope(clause, i, t.SAY, 12) else 1.0)
        return total

    clauses = [c for n in range(4) for c in itertools.product(letters, repeat=n)] + [[r.choice(letters) for _ in range(r.randrange(4, 30))] for _ in range(3000)]
    for clause in clauses:
        assert composed(clause) == pytest.approx(one_after_another(clause))
        if not {t.SELF, t.WILL, t.ACT} <= set(clause):  # no threat
            assert composed(clause) == pytest.approx(insults(clause)), clause
    assert composed([t.SELF, t.OTHER, t.WILL, t.ACT, t.OTHER, t.TARGET]) == t.THREAT
    assert composed([t.SELF, t.WILL, t.NOT, t.ACT, t.TARGET]) == 0 == composed([t.WILL, t.SELF, t.ACT, t.TARGET])
    assert composed([t.SAY, t.SELF, t.WILL, t.ACT, t.TARGET]) == t.THREAT * t.REPORTED


def test_toxicity_on_held_out_labels(spark):
    """The lexicon learns from the labels of odd identifiers and is held against those of even ones."""
    at = "/root/testdata/sf0.1"
    docs, labels = table(spark, at, "documents"), table(spark, at, "labels").where("toxic is not null")
    lexicon = toxicity.learn_lexicon(docs, labels.where("doc_id % 2 = 1"))
    held = docs.join(labels.where("doc_id % 2 = 0").select("doc_id", F.col("toxic").alias("mark")), "doc_id")
    found = {r.doc_id for r in toxicity.toxicity(held, lexicon=lexicon, carry=["doc_id"]).collect()}
    marks = {r.doc_id: r.mark for r in held.select("doc_id", "mark").collect()}
    toxic, clean = [i for i, x in marks.items() if x], [i for i, x in marks.items() if not x]
    assert len(toxic) > 150 and sum(i in found for i in toxic) >= 0.8 * len(toxic)
    assert sum(i in found for i in clean) <= 0.01 * len(clean)


def test_secrets_by_ownership(spark):
    key = lambda c: "AKIA" + c * 8 + "Q7ZK2M4X"
    rows = [(i, f"id = {key('B')}", f"s{i}") for i in range(4)] + [(10, f"k {key('C')} and {key('C')}", "s0"), (11, 'password = "your_password"', "s0")]
    got = {(r.doc_id, r.rule): r for r in secretscan.scan_secrets(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), min_entropy=1.0).collect()}
    assert all(got[i, "aws_access_key"].verdict == "shared_example" for i in range(4))
    assert got[10, "aws_access_key"].verdict == "owner_specific" and got[10, "aws_access_key"].n_in_doc == 2
    assert got[11, "assigned_secret"].verdict == "placeholder"


def test_licenses_against_every_block(docs):
    import random

    sets = licences.token_sets(licences.TEMPLATES, licences.THRESHOLD)
    r, rows = random.Random(2), [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
    for k, (_, text) in enumerate(licences.TEMPLATES):  # with words left out and put in
        own = [w for w in text.split() if r.random() < 0.93]
        for _ in range(len(own) // 12):
            own.insert(r.randrange(len(own)), "zz")
        rows.append((10_000 + k, "lead in " + "\n".join([" ".join(own), "the of and a " * 9, " ".join(own)])))
    want = set()
    for i, text in rows:
        words = re.findall(licences.TOKEN, text.lower())
        for k, _, tokens, least, width in sets:
            own, last = set(tokens), None
            for p, w in enumerate(words):
                if w in own and len(own & set(words[p : p + width])) >= least:
                    want |= {(i, p, k)} if last is None or p - last >= width else set()
                    last = p
    got = licences.scan_licenses(docs.sparkSession.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert len(want) > 30 and {(r.doc_id, r.block, r.template) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("clustered", [True, False])
def test_top_k_against_all_pairs(spark, clustered):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 8))
    if clustered:
        x = rng.normal(size=(30, 8))[rng.integers(0, 30, 900)] + 0.05 * x
    x[:200] = x[0]  # a group of copies larger than a block
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 12)
    np.fill_diagonal(s, -np.inf)
    asked = [i for i in range(900) if i % 7 == 0]
    got = {(r.vec_id, r.rank): (r.neighbour, r.score) for r in topk.top_k(df.repartition(5), k=5, queries=F.col("vec_id") % 7 == 0, block=64).collect()}
    assert len(got) == 5 * len(asked)
    for i in asked:
        best = np.lexsort((np.arange(900), -s[i]))[:5]
        assert [got[i, k + 1][0] for k in range(5)] == best.tolist()
        assert [got[i, k + 1][1] for k in range(5)] == pytest.approx(s[i, best].tolist())
    assert topk.top_k(df.where("vec_id < 70"), k=5, block=16).count() == 350


def test_lists_that_cannot_hold_an_answer_are_not_opened():
    import numpy as np

    rng = np.random.default_rng(5)
    q = np.eye(16)[:4]
    near, far = q[0] + 0.01 * rng.normal(size=(50, 16)), -q[0] + 0.01 * rng.normal(size=(50, 16))
    cut = np.full(4, 0.9)
    for x, hit in ((near, {0}), (far, set())):
        centre = x.mean(0)
        radius = np.array([np.linalg.norm(x[:, g] - centre[g], axis=1).max() for g in topk._shards(16)])
        i, j = topk.collect(q, cut, x, centre, radius)
        assert set(i.tolist()) == hit and len(j) == 50 * len(hit)


def test_pipeline_against_its_parts(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    kept = out.select("doc_id").distinct()
    texts = [r.text for r in out.join(kept, "doc_id").select("doc_id", "text").distinct().collect()]
    norm = [" ".join(t.split()) for t in texts]
    assert len(set(norm)) == len(norm)  # no two documents with the same content
    sets = {i: pairs_of(t) for i, t in enumerate(texts)}
    assert sum(n > 1 for n in linked(sets, 0.6).values()) <= 0.02 * len(sets)
    coder = bpe.Encoder(bpe.VOCAB)
    for r in out.select("text", "token_ids").limit(20).collect():
        assert coder.encode([r.text])[0].tolist() == r.token_ids
    assert out.where(F.col("token_ids").isNull()).count() == 0
