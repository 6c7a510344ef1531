"""Toxicity: a weighted finite-state grammar over clauses.

Words become classes through a lexicon. Five letter-to-letter transducers are composed into one machine: negation relabels an
insult or threat in its scope, reported speech relabels what follows a verb of saying, the target transducer relabels what
stands by a second or third person, the insult transducer weighs insults by their marks and an intensifier before them, and the
threat transducer follows a speaker, an intention, an act and a target in order and gives the weight when they are complete. A
clause's score is the weight of its path; a document's is the sum over its clauses. An insult that is negated, quoted or only
mentioned therefore counts little or nothing, wherever its words stand.

The lexicon has a built-in part and a part learned from labelled documents: words that occur in a good share of a language's
toxic documents and next to never in clean ones, equal texts counting once.

Texts are searched once for core words by an Aho-Corasick automaton; only clauses around a hit are taken apart.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import free_name, sized, written

# classes of words; a relabelling transducer adds a mark, as in "insult/neg"
OTHER, INSULT, MILD, STRONGER, TARGET, SELF, WILL, ACT, NOT, SAY = "other", "insult", "mild", "intensifier", "target", "self", "will", "act", "not", "say"

LEXICON: dict[str, str] = {
    w: c
    for c, words in {
        INSULT: "idiot idiots moron morons moronic imbecile imbeciles scum loser losers worthless retard bastard bastards bitch asshole assholes cretin cretins vermin degenerate whore slut dickhead dumbass scumbag idiota idiotas imbécile connard salaud crétin dummkopf trottel arschloch estúpido estúpida imbécil basura",
        MILD: "stupid trash pathetic disgusting clown clowns dumb fool fools garbage filthy filth ugly disgrace jerk pig pigs rat rats ignorant useless stupide dumm asqueroso",
        STRONGER: "such so total complete utter absolute fucking bloody damn real very truly",
        TARGET: "you your you're youre ya u yourself they them their he him she her these those tu te vous toi du dich sie ihr tú usted",
        SELF: "i we i'll we'll i'm we're ich wir je nous yo",
        WILL: "will shall gonna going want must should wanna i'll we'll werde voy vais",
        ACT: "kill hurt destroy shoot stab beat burn murder strangle hang punch töten tuer matar",
        NOT: "not no never isn't aren't wasn't don't doesn't didn't won't ain't neither nor without hardly nicht kein keine ne pas nunca",
        SAY: "said says say called calls call quoted wrote writes claimed claims reported reports shouted word term phrase told saying dijo sagte dit",
    }.items()
    for w in words.split()
}
WORD, BREAK = re.compile(r"[^\W_]+(?:['’][^\W_]+)*"), re.compile(r"[.!?;:\n\r|]")


class Transducer:
    """A deterministic letter-to-letter transducer with weights; letters without an arc take the state's default one."""

    def __init__(self, start):
        self.start, self.arcs, self.default = start, {}, {}

    def arc(self, state, letter, out, after, weight=0.0):
        self.arcs[state, letter] = (out, after, weight)

    def otherwise(self, state, after):
        """Any other letter is copied."""
        self.default[state] = after

    def step(self, state, letter):
        return self.arcs.get((state, letter)) or (letter, self.default[state], 0.0)


class Composed:
    """The machine that feeds the first one's output to the second; weights add. States are built as they are reached."""

    def __init__(self, first, second):
        self.first, self.second, self.start, self.known = first, second, (first.start, second.start), {}

    def step(self, state, letter):
        found = self.known.get((state, letter))
        if found is None:
            y, a, w = self.first.step(state[0], letter)
            z, b, v = self.second.step(state[1], y)
            found = self.known[state, letter] = (z, (a, b), w + v)
        return found


def within(trigger: str, reach: int, relabel: list[str], mark: str, passing: tuple[str, ...] = ()) -> Transducer:
    """Marks the letters in `relabel` that come at most `reach` letters after the trigger; `passing` letters use up no reach."""
    t = Transducer(0)
    for left in range(reach + 1):
        t.otherwise(left, max(left - 1, 0))
        t.arc(left, trigger, trigger, reach)
        for x in passing:
            t.arc(left, x, x, left)
        for x in relabel if left else ():
            t.arc(left, x, f"{x}/{mark}", left - 1)
    return t


WEIGHTS = {INSULT: 1.0, MILD: 0.6}
NEGATED, REPORTED, AIMED, INTENSE, THREAT = 0.0, 0.25, 1.5, 1.2, 3.0


MARKS = [f"{neg}{rep}{aim}" for neg in ("", "/neg") for rep in ("", "/rep") for aim in ("", "/aim")]


def insults() -> Transducer:
    """Weighs each insult by its marks; its state is how many letters an intensifier still reaches."""
    t = Transducer(0)
    for left in range(3):
        t.otherwise(left, max(left - 1, 0))
        t.arc(left, STRONGER, STRONGER, 2)
        for base, weight in WEIGHTS.items():
            for marks in MARKS:
                w = weight * (INTENSE if left else 1.0)
                for mark, factor in (("neg", NEGATED), ("rep", REPORTED), ("aim", AIMED)):
                    w *= factor if mark in marks else 1.0
                t.arc(left, base + marks, base + marks, max(left - 1, 0), w)
    return t


def threats() -> Transducer:
    """Weighs a speaker, an intention, an act and a target that follow each other within reach; a negated act breaks it off.

    A state is (what has been seen, letters left for what is missing); a reported act leads to a stage of its own.
    """
    t = Transducer("none")
    seen = {"self": 6, "will": 6, "act": 5, "act/rep": 5}
    states = ["none", *((stage, left) for stage, reach in seen.items() for left in range(1, reach + 1))]
    acts = [f"{ACT}{m}" for m in ("", "/neg", "/rep", "/neg/rep")]
    for state in states:
        stage, left = state if state != "none" else ("none", 0)
        t.otherwise(state, (stage, left - 1) if left > 1 else "none")
        t.arc(state, SELF, SELF, ("self", seen["self"]))
        if stage == "self":
            t.arc(state, WILL, WILL, ("will", seen["will"]))
        if stage == "will":
            for act in acts:
                t.arc(state, act, act, (act, seen[act]) if act in seen else "none")
        if stage.startswith("act"):
            t.arc(state, TARGET, TARGET, "none", THREAT * (REPORTED if stage == "act/rep" else 1.0))
    return t


def cascade() -> list[Transducer]:
    """Negation, reported speech, target, insult, threat."""
    cores = [INSULT, MILD, ACT]
    negation = within(NOT, 4, cores, "neg", (STRONGER,))
    reported = within(SAY, 12, [*cores, *(f"{x}/neg" for x in cores)], "rep")
    marked = [f"{x}{m}" for x in (INSULT, MILD) for m in ("", "/neg", "/rep", "/neg/rep")]
    return [negation, reported, within(TARGET, 5, marked, "aim", (STRONGER,)), insults(), threats()]


@cache
def grammar() -> Composed:
    """The transducers of the cascade composed into one machine."""
    machine, *rest = cascade()
    for t in rest:
        machine = Composed(machine, t)
    return machine


class Matcher:
    """A lexicon, and an automaton that finds its core words."""

    def __init__(self, lexicon: dict[str, str]):
        import ahocorasick

        self.lexicon, self.core = lexicon, ahocorasick.Automaton()
        for w, c in lexicon.items():
            if c in (INSULT, MILD, ACT):
                self.core.add_word(w, len(w))
        self.core.make_automaton()

    def clause_score(self, clause: str) -> float:
        """The weight of a lower-case clause's path; "i'll" counts as speaker and intention."""
        machine = grammar()
        state, total = machine.start, 0.0
        for m in WORD.finditer(clause):
            w = m[0].replace("’", "'")
            for c in (SELF, WILL) if w in ("i'll", "we'll") else (self.lexicon.get(w, OTHER),):
                _, state, v = machine.step(state, c)
                total += v
        return total

    def score(self, text: str) -> tuple[float, int, float]:
        """(sum of clause scores, number of clauses that score, the highest clause score) of a whole text."""
        low = text.lower()
        total, n, most, done = 0.0, 0, 0.0, -1
        for end, size in self.core.iter(low):
            a, b = end - size + 1, end + 1
            if a < done or (a and low[a - 1].isalnum()) or (b < len(low) and low[b].isalnum()):
                continue
            begin = max(0, done)
            for m in BREAK.finditer(low, begin, a):
                begin = m.end()
            m = BREAK.search(low, b)
            done = m.start() if m else len(low)
            v = self.clause_score(low[begin:done])
            if v > 0:
                total, n, most = total + v, n + 1, max(most, v)
        return total, n, most


_MATCHERS: dict[int, Matcher] = {}


def matcher(lexicon: dict[str, str]) -> Matcher:
    """One matcher a lexicon in each worker."""
    key = hash(frozenset(lexicon.items()))
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(lexicon)
    return _MATCHERS[key]


def _distinct_words(text: str | None) -> set[str]:
    return {m.replace("’", "'") for m in WORD.findall(text.lower())} if text else set()


def learn_lexicon(
    docs: DataFrame, labels: DataFrame, *, share: float = 0.04, precision: float = 0.95, least: int = 4,
    id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", label_col: str = "toxic",
) -> dict[str, str]:
    """Words to treat as mild insults, from labelled documents: {word: class}. One of them alone doesn't make a document toxic.

    A word is taken if it occurs in at least `share` of a language's toxic documents, and in `least` of them, and if at least
    `precision` of the documents it occurs in are toxic; equal texts of a language count once. All labelled rows are used. At most
    (words of a document / share) words a language can pass, so the lexicon doesn't grow with the corpus.

    Defined cases: rows with a null identifier, label, or a null or empty text teach nothing; an identifier that is labelled both
    ways counts as toxic; a null language is the language ""; extra columns are ignored; empty tables give an empty lexicon.
    """
    given = labels.select(F.col(id_col).alias("of"), F.col(label_col).alias("toxic")).where("of is not null and toxic is not null")
    given = given.groupBy("of").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    # one row of each content, found by hashes alone; so counts can be added up where the texts are and only words with their numbers are shuffled
    light = rows.select("row", "doc", "lang", F.xxhash64("text").alias("h"), F.length("text").alias("size")).join(sized(given), F.col("doc") == F.col("of"))
    leads = written(light.groupBy("lang", "toxic", "h", "size").agg(F.min("row").alias("lead")).select("lead", "toxic"), "labelled")
    rows = rows.join(sized(leads), F.col("row") == F.col("lead")).select("lang", "text", "toxic")
    toxic, clean = rows.where("toxic = 1"), rows.where("toxic = 0")

    def numbers(only: set[str] | None):
        """(lang, word, n) of each task's documents, n documents having the word; the word "" counts them all."""

        def run(batches):
            found: Counter = Counter()

            def flush():
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found]), pa.array([k[1] for k in found]), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])
                    found.clear()

            for batch in batches:
                for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                    own = _distinct_words(text)
                    found.update((lang, w) for w in (own if only is None else own & only))
                    found[lang, ""] += 1
                    if len(found) > 500_000:
                        yield from flush()
            yield from flush()

        return run

    def counted(part: DataFrame, only: set[str] | None) -> DataFrame:
        pairs = part.select("lang", "text").mapInArrow(numbers(only), "lang string, word string, n bigint")
        return pairs.groupBy("lang", "word").agg(F.sum("n").alias("n"))

    seen = written(counted(toxic, None), "toxic-words")
    all_docs = seen.where("word = ''").select("lang", F.col("n").alias("all"))  # a row a language
    often = seen.where("word <> ''").join(F.broadcast(all_docs), "lang").where((F.col("n") >= least) & (F.col("n") >= share * F.col("all")))
    bad: dict[str, int] = {}
    for r in often.groupBy("word").agg(F.sum("n").alias("n")).collect():
        bad[r.word] = r.n
    good = {r.word: r.n for r in counted(clean, set(bad)).groupBy("word").agg(F.sum("n").alias("n")).collect()} if bad else {}
    return {w: MILD for w, n in bad.items() if n >= precision * (n + good.get(w, 0))}


def toxicity(docs: DataFrame, *, lexicon: dict[str, str] | None = None, threshold: float = 1.0, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The rows whose text scores at least `threshold`, with toxicity (sum over clauses), toxic_clauses and worst_clause (the highest score).

    Clauses end at . ! ? ; : | and line breaks. Weights are 1 for an insult and 0.6 for a mild one, times 1.5 by a target, 1.2 by an
    intensifier, 0.25 in reported speech, 0 if negated; a threat has 3. `lexicon` has words to add to the built-in ones, as
    learn_lexicon gives them.

    Defined cases: null and empty texts score 0; whole texts are read whatever their length; repeated rows are judged one by one;
    extra columns pass through, and new columns that clash with them have underscores appended; an empty table gives an empty one.
    With a threshold of 0 or less every row is returned. `carry` names the columns to return besides the new ones.
    """
    carry = docs.columns if carry is None else carry
    names = [free_name(docs, x) for x in ("toxicity", "toxic_clauses", "worst_clause")]
    schema = T.StructType([*(docs.schema[c] for c in carry), T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType()), T.StructField(names[2], T.DoubleType())])
    at, words = len(carry), (lexicon or {}) | LEXICON

    def run(batches):
        judge = matcher(words)
        for batch in batches:
            scores = [judge.score(t) if t else (0.0, 0, 0.0) for t in batch.column(at).to_pylist()]
            keep = pa.array([s[0] >= threshold for s in scores], pa.bool_())
            new = [pa.array([s[i] for s in scores], k) for i, k in enumerate((pa.float64(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *new], names=schema.names).filter(keep)

    return docs.select(*carry, F.col(text_col).alias(free_name(docs, "judged"))).mapInArrow(run, schema)
