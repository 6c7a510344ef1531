"""The word model of the quality classifier: no folding, sums of one, the same scores whatever the files' splits."""

from pyspark.sql import functions as F

from meridio.llm import quality

DOCS = "doc_id bigint, text string, lang string"


def test_words_that_fold_alike_are_told_apart(spark):
    good = [(i, "THE CAT SAT ON A MAT. " * (1 + i), "en") for i in range(40)]
    docs = spark.createDataFrame([*good, (100, "THE CAT SAT ON A MAT.", "en"), (101, "XQV ZWK JQX VK Z QJX.", "en")], DOCS)
    assert quality.encode(["THE CAT SAT ON A MAT."])[0].tolist() == quality.encode(["XQV ZWK JQX VK Z QJX."])[0].tolist()
    got = {r.doc_id: r.perplexity for r in quality.quality_scores(docs, docs.where("doc_id < 40").select("doc_id")).collect()}
    assert got[101] > 1.05 * got[100]  # equal when characters alone are counted


def test_word_model_grows_with_the_text_and_sums_to_one(spark):
    text = lambda n: " ".join(f"w{i * i % n} v{i % 7}\nu{i % n}" for i in range(3 * n))
    sizes = []
    for n in (50, 500):
        counts = quality.word_counts(spark.createDataFrame([("en", text(n)), ("en", text(n)[::-1])], "lang string, text string")).cache()
        v = {r.key: r.v for r in quality.word_model(counts).collect()}
        left = v.pop(quality._root("en"))
        sizes.append(len(v))
        assert abs(sum(v.values()) + left - 1) < 1e-9 and 0 < left < 1
    assert sizes[1] > 4 * sizes[0]


def kneser_ney(texts, order=5):
    """Log probabilities of symbols by dictionaries, straight from the definition, and the words' layer on top of them."""
    import math
    from collections import Counter, defaultdict

    def grams(t):
        code, n = quality.encode([t])
        return [tuple(int(c) >> (quality.BITS * k) & 63 for k in range(order - 1, -1, -1)) for c in code]

    level, levels = Counter(g for t in texts for g in grams(t)), {}
    for k in range(order, 0, -1):
        levels[k] = level
        level = Counter(g[1:] for g in level)

    def discounts(counts):
        n = Counter(min(c, 5) for c in counts)
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        own = {}
        for i, default in ((1, 0.5), (2, 1.0), (3, 1.5)):
            ok = n[1] and n[2] and n[i] and n[i + 1]
            own[i] = min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i) if ok else default
        return own

    d = {k: discounts([c if c < 5 else 9 for c in v.values()]) for k, v in levels.items()}
    totals, rest = defaultdict(int), defaultdict(float)
    for k, v in levels.items():
        for g, c in v.items():
            totals[k, g[:-1]] += c
            rest[k, g[:-1]] += d[k][min(c, 3)]

    def p(g):
        x = 1 / 64
        for k in range(1, order + 1):
            h, own = g[order - k : -1], levels[k].get(g[order - k :], 0)
            if (k, h) in totals:
                x = (own - d[k][min(own, 3)] if own else 0) / totals[k, h] + rest[k, h] / totals[k, h] * x
        return x

    words = Counter(x for t in texts for x in zip(*_words(t)[:1]))
    dw, all_ = discounts([c if c < 5 else 9 for c in words.values()]), sum(words.values())
    left = sum(dw[min(c, 3)] for c in words.values()) / all_

    def logp(t):
        own = [math.log(p(g)) for g in grams(t)]
        keys, starts, ends = _words(t)
        total = sum(own)
        for w, a, e in zip(keys, starts, ends):
            spelled = sum(own[a:e])
            c = words.get((w,), 0)
            total += math.log((c - dw[min(c, 3)] if c else 0) / all_ + left * math.exp(spelled)) - spelled
        return total, len(own)

    return logp


def _words(t):
    _, _, starts, ends, h, _ = quality._encode([t])
    return h.tolist(), starts.tolist(), ends.tolist()


def test_perplexities_against_an_independent_model(spark):
    import math
    import random

    r = random.Random(3)
    vocabulary = ["the", "cat", "Sat", "on", "mats", "and", "dogs", "saw", "42", "logs", "log"]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(30)) + r.choice([".", "!\nso so", "\n"]), "en") for i in range(60)]
    rows += [(200 + i, " ".join(r.choice(["xq", "zv", "cat", "kkj"]) for _ in range(12)), "en") for i in range(10)]
    docs = spark.createDataFrame(rows, DOCS)
    halves = {x.doc_id: x.h for x in docs.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(2)).alias("h")).collect()}
    trusted = {i for i in range(60) if i % 4}
    models = [kneser_ney([t for i, t, _ in rows if i in trusted and halves[i] != h]) for h in (0, 1)]
    got = {x.doc_id: x.perplexity for x in quality.quality_scores(docs, docs.where("doc_id < 60 and doc_id % 4 <> 0").select("doc_id"), prior_chars=0.0).collect()}
    for i, t, _ in rows:
        total, n = models[halves[i]](t)
        assert abs(got[i] / math.exp(-total / n) - 1) < 1e-4, i
    assert min(got[i] for i in got if i >= 200) > max(got[i] for i in got if i < 60)


def test_splits_do_not_change_scores(spark, tmp_path):
    rows = [(i, f"the {i % 7} cats and {i % 11} dogs sat on the {'log' if i % 3 else 'mat'} of house {i}.", "en" if i % 2 else "de") for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    trusted = docs.where("doc_id % 5 <> 0").select("doc_id")
    docs.repartition(5).write.parquet(f"{tmp_path}/many")
    many = spark.read.parquet(f"{tmp_path}/many")
    scores = [{r.doc_id: round(r.perplexity, 6) for r in quality.quality_scores(x, trusted).collect()} for x in (docs, many, many.where("doc_id < 30").union(many.where("doc_id >= 30")))]
    assert len(scores[0]) == 60 and scores[0] == scores[1] == scores[2]


def test_a_trusted_row_is_not_judged_by_a_model_that_has_seen_it(spark):
    """In a language of few trusted rows as well: a row unlike all others has the same perplexity whether it is trusted or not."""
    rows = [(i, f"the {i % 7} cats and {i % 11} dogs sat on the log of house {i}.", "en") for i in range(30)] + [(99, "Quartz sphinx, judge my vow upon jolly wizard boxes!", "en")]
    docs = spark.createDataFrame(rows, DOCS)
    odd = []
    for beyond in (30, 100):
        ids = docs.where(F.col("doc_id") < beyond).select("doc_id")
        odd.append(next(r.perplexity for r in quality.quality_scores(docs, ids, prior_chars=0.0).collect() if r.doc_id == 99))
    assert abs(odd[0] / odd[1] - 1) < 1e-6
