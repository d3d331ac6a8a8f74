"""Problem 2: traces of print and recognition in scanned pages.

*Page furniture.* Running titles and page numbers are found by position and recurrence. A line's key folds together what
recognition confuses, so a misread title has its title's key; a title is a key that stands at an edge of at least two pages
of its deck and a tenth of them (or, in a chapter, five and three tenths of those from its first to its last), in few decks, and not with the same
neighbours each time (as headings of pages that were taken twice do). It has ``TITLE_LENGTH`` characters at most; longer lines are text. A page
number is a line of digits or Roman numerals, or the end of a running title, whose distance from the page's place in the
deck recurs there. All of this is grouping and joining on hashed keys; no deck, however large, is held in one task.

*Words.* One averaged perceptron edits characters. Each is kept, deleted, or replaced by one or two others (the second is an
insertion); a hyphen at a line end is kept, or the lines are joined there with or without it. A form's score is the sum of its
edits' weights over those of keeping, and of weights for how often the corpus has the form and what stands there now; the word is
misread if an edited form scores above the word as it is. Nothing else decides. The perceptron is trained on frequent words of this corpus, right and garbled
(``TRAINED`` words, a bound on labelled rows), in shards whose weights are averaged after every epoch; a step is as large as the loss asks.

*Tables.* Words and hyphenated line ends are counted over the whole corpus; the counts of a corpus of more than ``COUNTED_AS`` words
are scaled down to so many, for in a larger one every misreading occurs more often, and what a count means must not depend on that. Each different word is judged once: its edited forms
that could win are joined with the word counts, and the best is kept. What the pages have to look up are the words
with another form and the line ends to be joined. That table is broadcast while it has at most ``BROADCAST_ROWS`` rows; a
larger one is joined with the words of the pages.

*Repair.* Furniture lines are dropped, split words joined, misread words replaced, and wrapped lines of a paragraph joined.

Nulls and odd rows: null and blank texts have no damage; null doc_ids have no running titles; a null ``idx`` falls back on
``pageno``; copies of a page (same doc_id and idx) count as one page for titles and are each reported. Very long texts are read
whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: What recognition makes of printed characters (right: misread). Training words are garbled by it.
CONFUSED = {
    "a": ["o"], "b": ["8"], "c": ["("], "d": ["cl"], "e": ["c"], "f": ["{"], "g": ["q"], "h": ["b"], "i": ["!", "l"],
    "l": ["1"], "m": ["rn"], "n": ["ri"], "o": ["0"], "s": ["5"], "t": ["f"], "u": ["ii"], "w": ["vv"], "y": ["v"],
    "in": ["m"], "li": ["h"], "ti": ["u"], "rn": ["m"], "cl": ["d"],
}
HYPHENS = "-¬­‐"
#: Signs before a word that belong to it where they are a misread letter.
OPENING = "("
TRAINED, SHARDS, EPOCHS, LEAST, BROADCAST_ROWS = 3000, 4, 4, 3, 1_000_000
#: Words of a corpus to which the counts of a larger one are scaled.
COUNTED_AS = 4_000_000
#: Margin of the training, and the value of the features that come from the corpus (those of characters have 1).
MARGIN, LOUD = 3.0, 2.0
TITLE_PAGES, TITLE_SHARE, TITLE_DECKS, TITLE_RATE, TITLE_LETTERS, TITLE_LENGTH = 2, 0.1, 3, 0.001, 12, 200
CHAPTER_PAGES, CHAPTER_SHARE = 5, 0.3
#: A distance of page numbers from places is steady with this share of a deck's number lines, or so many of them.
NUMBER_SHARE, NUMBER_PAGES = 0.2, 20

_HYPHENATED = re.compile(rf"[{HYPHENS}][ \t]*\n")
_TOKEN = re.compile(r"\S+")
_TRIM = " .,;:?\"'“”„«»‘’*_#|[])…‹›>–—"
_LETTER = re.compile(r"[^\W\d_]")
_SPLIT = re.compile(rf"([\w!({{’'-]*[\w!({{])[ \t]?([{HYPHENS}])[ \t]*\n[ \t]*([\w!({{’'][\w!({{’'-]*)")


# -- words ---------------------------------------------------------------------------------------------------------------


def without_splits(text: str) -> str:
    """The text without the words that stand on both sides of a hyphenated line end."""
    return _SPLIT.sub(" ", text) if _HYPHENATED.search(text) else text


def tokens(text: str) -> list[str]:
    """Words with their inner signs, without the signs around them, in lower case."""
    return [t for w in text.lower().split() if (t := w.strip(_TRIM))]


def line_ends(text: str) -> list[tuple[str, str, str]]:
    """(left, hyphen, right) of the hyphenated line ends with letters on both sides, in small letters; also of those that a line with
    nothing but a number interrupts."""
    if not _HYPHENATED.search(text):
        return []
    out = []
    for t in {text, "\n".join(x for x in text.split("\n") if not _ALONE.fullmatch(x.lower()))}:
        out += [(m.group(1).lower().strip(_TRIM), m.group(2), m.group(3).lower().strip(_TRIM)) for m in _SPLIT.finditer(t)]
    return [x for x in out if _LETTER.search(x[0]) and _LETTER.search(x[2])]


def counted(pages: DataFrame) -> DataFrame:
    """(word, hyphen, right, n) of the whole corpus: words, with null ``hyphen`` and ``right``, and hyphenated line ends, whose
    words count for themselves only. Counting starts in the tasks."""

    def rows(seen: Counter, ends: Counter) -> pd.DataFrame:
        """Forms as they stand in the text, added up by the word in them."""
        words: Counter = Counter()
        for form, n in seen.items():
            if word := form.strip(_TRIM):
                words[word] += n
        out = [(w, None, None, n) for w, n in words.items()] + [(*e, n) for e, n in ends.items()]
        return pd.DataFrame(out, columns=["word", "hyphen", "right", "n"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, ends = Counter(), Counter()
        for pdf in batches:
            for t in pdf["content"]:
                seen.update(without_splits(t).lower().split())
                ends.update(line_ends(t))
            if len(seen) + len(ends) > 300_000:
                yield rows(seen, ends)
                seen.clear()
                ends.clear()
        yield rows(seen, ends)

    ok = pages.select("content").where("content IS NOT NULL").mapInPandas(run, "word string, hyphen string, right string, n bigint")
    return ok.groupBy("word", "hyphen", "right").agg(F.sum("n").alias("n"))


def scaled(words: DataFrame, most: int = COUNTED_AS) -> DataFrame:
    """The table of ``counted`` with its counts as a corpus of at most ``most`` words would have them; no row is left out."""
    total = words.where("hyphen IS NULL").agg(F.sum("n").alias("n")).first().n or 0
    return words.withColumn("n", F.col("n") / F.lit(max(1.0, total / most)))


# -- the averaged perceptron ---------------------------------------------------------------------------------------------

KEEP, EDIT, JOIN, OWN, NONE = "=", "edit", "join", "own", "none"


class Perceptron:
    """Averaged perceptron on sparse features with labels."""

    def __init__(self, weights: dict[str, dict[str, float]] | None = None):
        self.weights: dict[str, dict[str, float]] = defaultdict(dict, weights or {})
        self._sums: dict[tuple[str, str], float] = defaultdict(float)
        self._since: dict[tuple[str, str], int] = defaultdict(int)
        self._step = 0

    def scores(self, features: list[str]) -> dict[str, float]:
        out: dict[str, float] = defaultdict(float)
        for f in features:
            for label, w in self.weights.get(f, {}).items():
                out[label] += w
        return out

    def weight(self, feature: str, label: str) -> float:
        return self.weights.get(feature, {}).get(label, 0.0)

    def move(self, right: Counter, wrong: Counter, loss: float) -> None:
        """One step: towards the features (with labels) of the right answer, away from those of the wrong one, as far as makes up for the
        loss and no farther. Full steps would undo each other, as the features of counts come by the dozen."""
        apart = {key: by for key in right.keys() | wrong.keys() if (by := right[key] - wrong[key])}
        step = min(1.0, loss / max(1e-9, sum(by * by for by in apart.values())))
        for key, by in apart.items():
            f, label = key
            now = self.weights[f].get(label, 0.0)
            self._sums[key] += (self._step - self._since[key]) * now
            self._since[key] = self._step
            self.weights[f][label] = now + step * by

    def averaged(self) -> dict[tuple[str, str], float]:
        return {(f, label): (self._sums[f, label] + (self._step - self._since[f, label]) * w) / max(1, self._step) for f, row in self.weights.items() for label, w in row.items()}


def char_features(word: str, i: int) -> list[str]:
    p1, c, n1 = (word[j] if 0 <= j < len(word) else "^" for j in (i - 1, i, i + 1))
    return [f"c{c}", f"p{p1}{c}", f"n{c}{n1}", f"b{p1}{c}{n1}", f"d{c}{any(x.isdigit() for x in word)}"]


def bucket(n: float) -> int:
    return min(20, int(math.log2(n + 1)))


def ratio(own: float, n: float) -> int:
    return max(-20, min(5, math.floor(math.log2((own + 0.5) / (n + 0.5)))))


def corpus_features(own: float, n: float, edits: int) -> list[str]:
    """Of a form that the corpus has ``n`` times in place of a word that it has ``own`` times: every step up to each bucket, so that what
    is learned of one holds for those beyond it."""
    return [f"edits{edits}", *[f"form{k}" for k in range(bucket(n) + 1)], *[f"ratio{k}" for k in range(-20, ratio(own, n) + 1)], *[f"own{k}" for k in range(bucket(own) + 1)]]


def join_features(left: str, hyphen: str, right: str, n: dict[str, float]) -> list[str]:
    """Of a hyphen between the ends of two lines, with the counts of the words around it."""
    whole, own, a, b = (n.get(x, 0) >= LEAST for x in (left + right, f"{left}-{right}", left, right))
    more = n.get(left + right, 0) > n.get(f"{left}-{right}", 0)
    return ["j", f"jh{hyphen == '-'}", f"jw{whole}o{own}", f"jmore{more}", f"jl{a}r{b}w{whole}o{own}", f"jletters{left[-1:].isalpha() and right[:1].isalpha()}"]


class Editor:
    """The perceptron's edits of a word."""

    def __init__(self, weights: dict[str, dict[str, float]], longest: int = 60):
        self.model, self.longest = Perceptron(weights), longest
        w = lambda f: LOUD * (self.model.weight(f, EDIT) - self.model.weight(f, KEEP))
        self.form = list(accumulate(w(f"form{k}") for k in range(21)))
        self.ratio = list(accumulate(w(f"ratio{k}") for k in range(-20, 6)))
        self.own = list(accumulate(w(f"own{k}") for k in range(21)))
        self.edits = [w(f"edits{k}") for k in (1, 2)]

    def units(self, word: str) -> list[tuple[float, int, int, str, tuple]]:
        """(gain over keeping, from, to, text put there, labels) of each edit of one place: replacements, those that delete the next
        character too, and deletions."""
        out = [self.model.scores(char_features(word, i)) for i in range(len(word))]
        gain = [{e: v - o.get(KEEP, 0.0) for e, v in o.items() if e == "" or e[0] == "=" and e != KEEP} for o in out]
        units = []
        for i, edits in enumerate(gain):
            for e, v in edits.items():
                units.append((v, i, i + 1, e[1:], ((i, e),)))
                if e and i + 1 < len(word) and "" in gain[i + 1]:
                    units.append((v + gain[i + 1][""], i, i + 2, e[1:], ((i, e), (i + 1, ""))))
        return units

    def every_form(self, word: str) -> dict[str, tuple]:
        """form -> labels, of all forms by one or two edits."""
        units, out = self.units(word), {}
        for k, (_, i, j, e, ops) in enumerate(units):
            out.setdefault(word[:i] + e + word[j:], ops)
        for k, (_, i, j, e, ops) in enumerate(units):
            for _, a, b, f, more in units[k + 1 :]:
                if j <= a:
                    out.setdefault(word[:i] + e + word[j:a] + f + word[b:], ops + more)
        out.pop(word, None)
        return out

    def forms(self, word: str, own: float) -> list[tuple[str, float, int]]:
        """(form, gain, number of edits): every form by one or two edits that could win if the corpus has it as often as is best for it."""
        if len(word) > self.longest + 2:  # no word that occurs LEAST times is as long
            return []
        units = sorted(self.units(word), key=lambda u: -u[0])
        most = max(self.form) + max(self.ratio) + self.own[bucket(own)]
        out: dict[str, tuple[float, int]] = {}
        for v, i, j, e, _ in units:
            if v + most + self.edits[0] <= 0:
                break
            form = word[:i] + e + word[j:]
            if form not in out and form != word:
                out[form] = (v + self.edits[0], 1)
        floor = -most - self.edits[1]
        for k, (v, i, j, e, _) in enumerate(units):
            if 2 * v <= floor:
                break
            for w, a, b, f, _ in units[k + 1 :]:
                if v + w <= floor:
                    break
                if j <= a or b <= i:
                    x, y = ((i, j, e), (a, b, f)) if j <= a else ((a, b, f), (i, j, e))
                    form = word[: x[0]] + x[2] + word[x[1] : y[0]] + y[2] + word[y[1] :]
                    if form != word and (form not in out or out[form][0] < v + w + self.edits[1]):
                        out[form] = (v + w + self.edits[1], 2)
        return [(f, g, k) for f, (g, k) in out.items() if f]

    def join(self, left: str, hyphen: str, right: str, n: dict[str, float]) -> str:
        out = self.model.scores(join_features(left, hyphen, right, n))
        return max((NONE, JOIN, OWN), key=lambda k: out.get(k, 0.0))  # the first of equals: nothing is joined without a reason


def garble(word: str, rng: np.random.Generator, edits: list | None = None) -> tuple[str, list[tuple[int, str]]] | None:
    """A misread form of the word, and the edits of its characters that restore the word. With ``edits``, one more error in a form that
    they restore."""
    taken = {i for i, _ in edits or []}
    spots = [(i, a, b) for a, bs in CONFUSED.items() for b in bs for i in range(len(word)) if word.startswith(a, i) and not taken & set(range(i - 1, i + len(a) + 1))]
    if not spots:
        return None
    i, a, b = spots[int(rng.integers(len(spots)))]
    moved = [(k + (len(b) - len(a)) * (k > i), e) for k, e in edits or []]
    return word[:i] + b + word[i + len(a) :], sorted([*moved, (i, f"={a}"), *[(i + k, "") for k in range(1, len(b))]])


def examples(pool: list[str]) -> list[tuple[str, list]]:
    """Training examples of the words: ("word", [form, its right edits]), each word right, twice garbled and garbled in two places;
    ("word", [form, [], letter, share]), right words behind a parenthesis ("(as"), as if the corpus had the word that begins with the letter
    which is misread as one ("cas") so many times for each of theirs; and
    ("end", [left, hyphen, right, label, hidden]): words cut anywhere are to be joined, words with a hyphen of their own cut at it
    are not, nor are two words with a dash between them."""
    rng, out = np.random.default_rng(2), []
    plain = [w for w in pool if w.isalpha()]
    for w in plain:
        once, again = garble(w, rng), garble(w, rng)
        twice = once and garble(once[0], rng, once[1])
        out += [("word", [w, []]), *[("word", list(g)) for g in (once, again, twice) if g]]
    rivals = [(a, sign) for a, bs in CONFUSED.items() for sign in bs if sign in OPENING]
    out += [("word", [sign + w, [], a, 2.0 ** -int(rng.integers(-2, 13))]) for w in plain[::3] for a, sign in rivals]
    long = [w for w in plain if len(w) >= 5]
    owned = [w for w in pool if w.count("-") == 1 and all(x.isalpha() for x in w.split("-"))]
    for k, w in enumerate(long):
        at = int(rng.integers(2, len(w) - 1))
        out.append(("end", [w[:at], HYPHENS[k % 4], w[at:], JOIN, k % 4 == 0]))  # some as if the corpus lacked the word
        beside = long[(k * 7 + 1) % len(long)]
        out.append(("end", [w, "-", beside, NONE, False]))
        if owned:
            a, b = owned[k % len(owned)].split("-")
            out.append(("end", [a, HYPHENS[k % 2 * 3], b, OWN, False]))
    order = rng.permutation(len(out))
    return [out[k] for k in order]


def _labels(word: str, ops) -> Counter:
    out: Counter = Counter()
    for i, e in ops:
        for f in char_features(word, i):
            out[f, e] += 1
            out[f, KEEP] -= 1
    return out


def _inventory(shown: list[tuple[str, list]]) -> dict[str, dict[str, float]]:
    """The edits that the examples show of each character, with weights of 0 to start from."""
    start: dict[str, dict[str, float]] = defaultdict(dict)
    for kind, x in shown:
        if kind == "word":
            for i, e in x[1]:
                start[f"c{x[0][i]}"][e] = 0.0
    return start


def candidates(shown: DataFrame, words: DataFrame, start: dict[str, dict[str, float]]) -> DataFrame:
    """(id, kind, what, known): the examples with what the corpus has of their words and of all their forms by one or two edits, as
    JSON lists of (form, labels, count)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        editor = Editor(start)
        for pdf in batches:
            rows = []
            for i, kind, what in zip(pdf["id"], pdf["kind"], pdf["what"]):
                x = json.loads(what)
                if kind == "end":
                    rows += [(i, w, None) for w in {x[0] + x[2], f"{x[0]}-{x[2]}", x[0], x[2]}]
                else:
                    rows += [*[(i, w, None) for w in {x[0], x[0].lstrip(OPENING)}], *[(i, f, json.dumps(ops)) for f, ops in editor.every_form(x[0]).items()]]
            yield pd.DataFrame(rows, columns=["id", "word", "ops"])

    asked = shown.mapInPandas(run, "id int, word string, ops string").join(words.where("hyphen IS NULL").select("word", "n"), "word")
    known = asked.groupBy("id").agg(F.to_json(F.collect_list(F.struct("word", "ops", "n"))).alias("known"))
    return shown.join(known, "id", "left")


def trained(shown: list[tuple], weights: dict[str, dict[str, float]]) -> dict[tuple[str, str], float]:
    """Averaged weights (feature, label) after one epoch over examples (kind, what, known). A word's candidates are itself, its forms that the
    corpus has LEAST times, and the right one. The right answer has to win by MARGIN."""
    model = Perceptron({f: dict(r) for f, r in weights.items()})
    editor = Editor({})
    editor.model = model
    for kind, x, known in shown:
        model._step += 1
        n = {k["word"]: k["n"] for k in known}
        if kind == "end":
            left, hyphen, right, label, hidden = x
            f = join_features(left, hyphen, right, {**n, left + right: 0} if hidden else n)
            out = model.scores(f)
            guess = max((k for k in (JOIN, OWN, NONE) if k != label), key=lambda k: (out.get(k, 0.0), k))
            if (loss := out.get(guess, 0.0) + MARGIN - out.get(label, 0.0)) > 0:
                model.move(Counter({(y, label): 1 for y in f}), Counter({(y, guess): 1 for y in f}), loss)
            continue
        word, gold = x[0], tuple(map(tuple, x[1]))
        own = sum(n.get(w, 0) for w in {word, word.lstrip(OPENING)})  # as word_verdicts counts it
        # (labels, features of the corpus, gain)
        options = [((), [], 0.0)]
        forms = [(tuple(map(tuple, json.loads(k["ops"]))), k["n"]) for k in known if k.get("ops") and k["n"] >= LEAST]
        if gold and gold not in [ops for ops, _ in forms]:
            forms.append((gold, 0))
        if len(x) > 2:
            forms.append((((0, f"={x[2]}"),), max(LEAST, own * x[3])))
        at = {i: model.scores(char_features(word, i)) for i in {i for ops, _ in forms for i, _ in ops}}
        for ops, m in forms:
            lex = corpus_features(own, m, 1 if len(ops) == 1 or (len(ops) == 2 and ops[1][1] == "" and ops[1][0] == ops[0][0] + 1) else 2)
            gain = sum(at[i].get(e, 0.0) - at[i].get(KEEP, 0.0) for i, e in ops)
            options.append((ops, lex, gain + LOUD * sum(model.weight(y, EDIT) - model.weight(y, KEEP) for y in lex)))
        want = next(o for o in options if o[0] == gold)
        best = max((o for o in options if o[0] != gold), key=lambda o: (o[2], -len(o[0])), default=None)
        if best is not None and (loss := best[2] + MARGIN - want[2]) > 0:
            a, b = Counter(), Counter()
            for counts, o in ((a, want), (b, best)):
                counts.update({(y, EDIT): LOUD for y in o[1]})
                for key, by in _labels(word, o[0]).items():
                    counts[key] += by
            model.move(a, b, loss)
    return model.averaged()


def train(words: DataFrame) -> dict[str, dict[str, float]]:
    """The editor's weights. Examples are made of the most frequent words, TRAINED at most, and stored with what the corpus has of their forms;
    in every epoch shards of them are trained in tasks, and the weights averaged."""
    spark = words.sparkSession
    usual = words.where(F.col("hyphen").isNull() & (F.col("n") >= 2 * LEAST) & F.col("word").rlike(r"^[\p{L}-]{2,40}$")).orderBy(F.desc("n"), "word").limit(TRAINED)
    made = examples([r.word for r in usual.select("word").toLocalIterator()])
    weights = _inventory(made)
    if not made:
        return {}
    shown = spark.createDataFrame([(k, kind, json.dumps(x)) for k, (kind, x) in enumerate(made)], "id int, kind string, what string").repartition(SHARDS * 2)
    table = stored(candidates(shown, words, weights).repartitionById(SHARDS, F.col("id") % SHARDS), "examples")
    for _ in range(EPOCHS):
        now = spark.sparkContext.broadcast({f: dict(r) for f, r in weights.items()})

        def run(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                pdf = pdf.sort_values("id")
                out = trained([(k, json.loads(x), json.loads(n) if n else []) for k, x, n in zip(pdf["kind"], pdf["what"], pdf["known"])], now.value)
                yield pd.DataFrame([(f, label, w, len(pdf)) for (f, label), w in out.items()], columns=["feature", "label", "w", "of"])

        rows = stored(table.mapInPandas(run, "feature string, label string, w double, of bigint"), "weights")
        shards = rows.groupBy("feature", "label").agg(F.sum(F.col("w") * F.col("of")).alias("w"), F.sum("of").alias("of"))
        weights = defaultdict(dict)
        for r in shards.toLocalIterator():
            weights[r.feature][r.label] = r.w / len(made)
    return dict(weights)


# -- verdicts on words and line ends -------------------------------------------------------------------------------------

END = "\x1f"


def line_end_verdicts(words: DataFrame, editor) -> DataFrame:
    """(key, value): hyphenated line ends (left, hyphen, right with END between) that are to be joined, and how."""
    ends = words.where("hyphen IS NOT NULL").select(F.col("word").alias("left"), "hyphen", "right").withColumn("key", F.concat_ws(END, "left", "hyphen", "right"))
    asked = F.explode(F.array(F.concat("left", "right"), F.concat_ws("-", "left", "right"), F.col("left"), F.col("right"))).alias("word")
    known = ends.select("key", asked).join(words.where("hyphen IS NULL").select("word", "n"), "word").groupBy("key").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("word", "n")))).alias("n"))
    rows = ends.join(known, "key", "left").select("left", "hyphen", "right", "key", F.to_json("n").alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Editor(*editor.value)
        for pdf in batches:
            what = [model.join(a, h, b, json.loads(n) if n else {}) for a, h, b, n in zip(pdf["left"], pdf["hyphen"], pdf["right"], pdf["n"])]
            yield pd.DataFrame({"key": pdf["key"], "value": what})

    return rows.mapInPandas(run, "key string, value string").where(F.col("value") != NONE)


def word_verdicts(words: DataFrame, editor, model: Editor) -> DataFrame:
    """(key, value): misread words and what they were. Hyphenated ones are judged as a whole, and rare ones by part."""
    plain = words.where("hyphen IS NULL").select("word", "n")
    compound = plain.where(F.col("word").rlike("[-’]") & (F.col("n") < LEAST)).select("word", F.explode(F.split("word", "[-’]")).alias("part")).where(F.length("part") > 2)
    more = words.where("hyphen IS NOT NULL").select(F.concat("word", "right").alias("word")).unionByName(compound.select(F.col("part").alias("word")))
    # behind a parenthesis a word counts as itself
    opened = plain.where(F.col("word").startswith("(")).select(F.col("word").alias("whole"), F.expr("substring(word, 2)").alias("word")).join(plain, "word").select(F.col("whole").alias("word"), "n")
    judged = plain.unionByName(opened).unionByName(more.withColumn("n", F.lit(0.0))).groupBy("word").agg(F.sum(F.col("n").cast("double")).alias("own")).where(F.col("word").rlike(r"\p{L}"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edits = Editor(*editor.value)
        for pdf in batches:
            rows = [(w, own, *f) for w, own in zip(pdf["word"], pdf["own"]) for f in edits.forms(w, own)]
            yield pd.DataFrame(rows, columns=["was", "own", "word", "gain", "edits"])

    forms = judged.mapInPandas(run, "was string, own double, word string, gain double, edits int")
    forms = forms.join(plain.where(F.col("n") >= LEAST), "word")
    array = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    size = lambda c: F.least(F.lit(20), F.floor(F.log2(F.col(c) + 1.0))).cast("int")
    beside = F.greatest(F.lit(-20), F.least(F.lit(5), F.floor(F.log2((F.col("own") + 0.5) / (F.col("n") + 0.5))))).cast("int")
    score = F.col("gain") + array(model.form)[size("n")] + array(model.ratio)[beside + 20] + array(model.own)[size("own")]
    best = forms.withColumn("score", score).where("score > 0").groupBy("was").agg(F.max(F.struct("score", "n", "word")).alias("b"))
    misread = best.select(F.col("was").alias("key"), F.col("b.word").alias("value"))
    # rare compounds with a misread part, of the parts that the corpus lacks as words
    rare = compound.join(plain.where(F.col("n") >= LEAST).select(F.col("word").alias("part")), "part", "left_anti").join(misread.select(F.col("key").alias("part"), "value"), "part")
    fixed = rare.groupBy("word").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("part", "value")))).alias("m")).join(misread.select(F.col("key").alias("word")), "word", "left_anti")
    whole = F.concat(*[x for x in [F.array_join(F.transform(F.regexp_extract_all("word", F.lit("[-’]|[^-’]+"), F.lit(0)), lambda x: F.coalesce(F.col("m")[x], x)), "")]])
    return misread.unionByName(fixed.select(F.col("word").alias("key"), whole.alias("value")))


def page_keys(text: str) -> set[str]:
    """All keys under which a page may have to be looked up."""
    return {w.strip(_TRIM) for w in text.lower().split()} | {END.join(e) for e in line_ends(text)} | {a + b for a, _, b in line_ends(text)}


# -- page furniture ------------------------------------------------------------------------------------------------------

_NUMBER = r"(\d{1,4}|[ivxlcdm]{1,9})"
_PRINTED = rf"[\[(–—\-~]*\s*(?:(?:pp?|s|str|pág|pag|page|seite|página|стр|с)\.?\s*)?{_NUMBER}(?:\s*(?:/|of|von|sur|de|из)\s*\d{{1,4}})?\s*[\])–—\-~.]*"
#: A printed page number alone on its line, set off by signs, and before or behind a running title.
_ALONE = re.compile(rf"\s*{_PRINTED}\s*")
_MARKED = re.compile(r"\s*(?:[\[(–—\-~p]|page|seite|página|стр)|.*/")
_START, _END = re.compile(rf"\s*{_PRINTED}[\s|·]+(?=\S)"), re.compile(rf"[\s|·]+{_PRINTED}\s*$")
_ROMAN = re.compile(r"m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})")
#: Captions, headings, list entries and lines garbled by a wrong encoding recur in copies of a page, but are no titles.
_NO_TITLE = re.compile(r"\s*(?:[#|]|\*\*|[•*–\-] |(?i:fig(?:ure|ura|\.)?)\s*\d)|.*(?:[\x80-\x9f\u2500-\u259f\ufffd]|[ÐÑÃÂ].[ÐÑÃÂ]|[ÃÂ][\x80-\xbf]|â€|├|вЂ|–[°-ſА-я]–)|.*(?:\. ?){3,}\s*\d*\s*$")
_MANY = (("rn", "m"), ("ri", "n"), ("in", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("ti", "u"), ("li", "h"), ("l1", "h"), ("1i", "h"), ("t!", "u"), ("l!", "h"), ("!n", "m"))
_ONE = str.maketrans("co({5810!fbqlv", "eaetshiaithgiy")
_OTHER = re.compile(r"[\W\d_]+")


def folded(line: str) -> str:
    """Letters alone, with everything folded together that recognition takes for one another."""
    x = line.lower()
    for many, one in _MANY:
        if many in x:
            x = x.replace(many, one)
    return _OTHER.sub("", x.translate(_ONE))


def number_value(text: str) -> int | None:
    """The value of digits or of a Roman numeral in small letters; None for letters that form none."""
    if text.isdigit():
        return int(text)
    if not _ROMAN.fullmatch(text):
        return None
    each = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}[c] for c in text]
    return sum(-v if v < max(each[i + 1 : i + 2], default=0) else v for i, v in enumerate(each))


def line_features(text: str) -> list[tuple[int, bool, int | None, int | None, int | None, bool]]:
    """(line_no, at an edge, key of a possible title, key of the line next to it, value of a possible page number, whether that
    number is set off by signs at an edge) of the lines that may be furniture. Most of it stands at an edge of the page, but a
    page that was recognised in two columns or halves has some in the middle."""
    lines = text.split("\n")
    filled = [i for i, x in enumerate(lines) if x and not x.isspace()]
    last, out = len(filled) - 1, []
    for n, i in enumerate(filled):
        line = lines[i]
        edge = n <= 1 or n >= last - 1
        if (m := _ALONE.fullmatch(low := line.lower())) and (value := number_value(m.group(1))) is not None:
            out.append((i, edge, None, None, value, edge and bool(_MARKED.match(low))))
            continue
        if len(line) > TITLE_LENGTH or _NO_TITLE.match(line):
            continue
        value, low = None, line.lower()
        if (m := _END.search(low) or _START.match(low)) and (value := number_value(m.group(1))) is not None:
            line = line[: m.start()] + line[m.end() :]
        letters = folded(line)
        if len(letters) >= TITLE_LETTERS:
            by = filled[n + 1] if (n * 2 < len(filled) or n == 0) and n < last else filled[n - 1] if n else None
            beside = xxhash.xxh3_64_intdigest(lines[by]) - (1 << 63) if by is not None else 0
            out.append((i, edge, xxhash.xxh3_64_intdigest(letters) - (1 << 63), beside, value, False))
    return out


def page_lines(pages: DataFrame) -> DataFrame:
    """(doc, page, chunk_id, line_no, edge, key, beside, value, sure) of all lines that may be furniture. ``doc`` is a hash of the
    doc_id, ``page`` the place in the deck from 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, p, i, *f) for d, p, i, t in zip(pdf["doc"], pdf["page"], pdf["chunk_id"], pdf["content"]) for f in line_features(t)]
            out = pd.DataFrame(rows, columns=["doc", "page", "chunk_id", "line_no", "edge", "key", "beside", "value", "sure"], dtype=object)
            yield out

    at = F.coalesce(F.col("idx"), F.col("pageno").cast("int") - 1)
    ok = pages.where(F.col("content").isNotNull() & F.col("doc_id").isNotNull() & at.isNotNull()).select(F.xxhash64("doc_id").alias("doc"), at.alias("page"), "chunk_id", "content")
    return ok.mapInPandas(run, "doc bigint, page int, chunk_id bigint, line_no int, edge boolean, key bigint, beside bigint, value int, sure boolean")


def furniture(pages: DataFrame) -> DataFrame:
    """(chunk_id, line_no, what): running titles ('runhead') and printed page numbers ('pageno'); a line can be both."""
    lines = stored(page_lines(pages), "lines")
    keyed = lines.where("key IS NOT NULL")
    per_page = keyed.groupBy("key", "doc", "page").agg(F.max(F.col("edge").cast("int")).alias("edge"), F.min("beside").alias("beside"))
    per_deck = per_page.groupBy("key", "doc").agg(F.count("*").alias("pages"), F.sum("edge").alias("edges"), (F.min("beside") < F.max("beside")).alias("moves"), (F.max("page") - F.min("page") + 1).alias("span"))
    decks = per_deck.groupBy("key").agg(F.count("*").alias("decks"))
    sizes = pages.groupBy(F.xxhash64("doc_id").alias("doc")).agg(F.count("*").alias("rows"))
    # of all pages of the deck, or, for a chapter of a long deck, of those from the title's first to its last
    chapter = (F.col("pages") >= CHAPTER_PAGES) & (F.col("pages") >= F.col("span") * F.lit(CHAPTER_SHARE))
    often = per_deck.where((F.col("pages") >= TITLE_PAGES) & (F.col("edges") >= 1) & F.col("moves")).join(sizes, "doc").where(chapter | (F.col("pages") >= F.col("rows") * F.lit(TITLE_SHARE)))
    most = F.greatest(F.lit(TITLE_DECKS), F.col("all") * F.lit(TITLE_RATE))
    all_decks = F.broadcast(pages.agg(F.count_distinct("doc_id").alias("all")))  # one row
    titles = stored(often.join(decks.join(all_decks).where(F.col("decks") <= most), "key").select("doc", "key"), "titles")
    heads = keyed.join(titles, ["doc", "key"])
    numbers = heads.where("value IS NOT NULL").withColumn("sure", F.lit(True)).select("doc", "page", "chunk_id", "line_no", "value", "sure")
    numbers = numbers.unionByName(lines.where("key IS NULL").select("doc", "page", "chunk_id", "line_no", "value", "sure")).withColumn("gap", F.col("value") - F.col("page"))
    numbers = stored(numbers, "numbers")
    gaps = numbers.groupBy("doc", "gap").agg(F.count_distinct("page").alias("pages"), F.count("*").alias("rows"))
    total = gaps.groupBy("doc").agg(F.sum("rows").alias("all"))
    steady = gaps.join(total, "doc").where(((F.col("pages") >= 2) & (F.col("rows") >= F.least(F.col("all") * NUMBER_SHARE, F.lit(NUMBER_PAGES)))) | (F.col("gap") == 1))
    # a number beside a title, or set off by signs at an edge of the page, needs no second witness
    paged = numbers.join(steady.select("doc", "gap", F.lit(True).alias("steady")), ["doc", "gap"], "left").where(F.col("sure") | F.col("steady"))
    return heads.select("chunk_id", "line_no", F.lit("runhead").alias("what")).unionByName(paged.select("chunk_id", "line_no", F.lit("pageno").alias("what"))).distinct()


# -- pages ---------------------------------------------------------------------------------------------------------------

_HEADING = re.compile(r"^\s*(#|\*\*|\||[•*–-] |\d+[.)]? )")


def raw_form(raw: str, verdicts: dict[str, str]) -> str | None:
    """A word as it stands in the text, with the signs around it: what it was, or None if it isn't misread."""
    core = raw.strip(_TRIM)
    form = verdicts.get(core.lower()) if core else None
    return form and raw.replace(core, form.capitalize() if core[:1].isupper() else form, 1)


def read_page(text: str, dropped: set[int], verdicts: dict[str, str]) -> tuple[str, bool, bool]:
    """(repaired text, whether a word was split over a line end, whether a word was misread). A page without any damage is
    left as it is; on others wrapped lines are joined to paragraphs."""
    lines = [x.rstrip() for i, x in enumerate(text.split("\n")) if i not in dropped]
    body, hyphen, misread = "\n".join(lines), False, False

    def joined(m: re.Match) -> str:
        nonlocal hyphen, misread
        left, sign, right = m.group(1).lower().strip(_TRIM), m.group(2), m.group(3).lower().strip(_TRIM)
        what = verdicts.get(END.join((left, sign, right)))
        if what == JOIN and (form := verdicts.get(left + right)):
            misread = hyphen = True
            return form
        if what == JOIN:
            hyphen = True
            return m.group(1) + m.group(3)
        return m.group(1) + "-" + m.group(3) if what == OWN else m.group()

    if _HYPHENATED.search(body):
        body = _SPLIT.sub(joined, body)

    wrong = {raw: new for raw in set(body.split()) if (new := raw_form(raw, verdicts)) is not None}
    if wrong:
        misread = True
        body = _TOKEN.sub(lambda m: wrong.get(m.group(), m.group()), body)
    if not (hyphen or misread or dropped):
        return text, False, False
    out: list[str] = []
    for line in body.split("\n"):
        whole = out and out[-1] and line and not _HEADING.match(line) and not out[-1].lstrip().startswith(("#", "|"))
        if whole:
            out[-1] += " " + line.lstrip()
        else:
            out.append(line)
    return "\n".join(out), hyphen, misread


def with_verdicts(pages: DataFrame, verdicts: DataFrame, most: int = BROADCAST_ROWS) -> tuple[DataFrame, object]:
    """The pages (chunk_id, content), and the broadcast verdicts; or, if there are more than ``most``, the pages each with a map of its own, in ``found``."""
    if verdicts.limit(most + 1).count() <= most:
        table = dict(r for r in verdicts.toLocalIterator())
        return pages.withColumn("found", F.lit(None).cast("string")), pages.sparkSession.sparkContext.broadcast(table)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(i, k) for i, t in zip(pdf["chunk_id"], pdf["content"]) for k in page_keys(t)], columns=["chunk_id", "key"])

    asked = pages.select("chunk_id", "content").mapInPandas(keys, "chunk_id bigint, key string")
    own = asked.join(verdicts, "key").distinct().groupBy("chunk_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "value")))).alias("found"))
    return pages.join(own, "chunk_id", "left"), None


def repaired(pages: DataFrame) -> DataFrame:
    """(chunk_id, text, damage): every page with a text, repaired, and the kinds of damage that were found on it."""
    spark = pages.sparkSession
    words = scaled(stored(counted(pages), "words"))
    longest = words.where(F.col("hyphen").isNull() & (F.col("n") >= LEAST)).agg(F.max(F.length("word")).alias("n")).first().n or 0
    weights = train(words)
    editor = spark.sparkContext.broadcast((weights, longest))
    verdicts = stored(word_verdicts(words, editor, Editor(weights, longest)).unionByName(line_end_verdicts(words, editor)), "verdicts")
    kind = {what: F.collect_set(F.when(F.col("what") == what, F.col("line_no"))).alias(what) for what in ("runhead", "pageno")}
    drops = furniture(pages).groupBy("chunk_id").agg(*kind.values())
    some, table = with_verdicts(pages.where(F.col("content").isNotNull()).select("chunk_id", "content"), verdicts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text, own, heads, numbers in zip(pdf["chunk_id"], pdf["content"], pdf["found"], pdf["runhead"], pdf["pageno"]):
                heads, numbers = (() if x is None else x for x in (heads, numbers))
                known = table.value if table is not None else json.loads(own) if own else {}
                fixed, hyphen, misread = read_page(text, {*heads, *numbers}, known)
                if len(heads) and not misread:  # a word of a running title may be misread too
                    parts = text.split("\n")
                    misread = any(t in known for n in heads for t in tokens(parts[n]))
                found = {"runhead": len(heads), "pageno": len(numbers), "hyphen": hyphen, "misread": misread}
                rows.append((i, fixed, [k for k, v in found.items() if v]))
            yield pd.DataFrame(rows, columns=["chunk_id", "text", "damage"])

    return some.join(drops, "chunk_id", "left").mapInPandas(run, "chunk_id bigint, text string, damage array<string>")


def damages(pages: DataFrame) -> DataFrame:
    """(chunk_id, damage): one row for each kind of damage on a page."""
    return repaired(pages).select("chunk_id", F.explode("damage").alias("damage")).distinct()
